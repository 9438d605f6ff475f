"""Jobs whose memory and disk must not follow the size of a batch."""

import os
from datetime import date

import pytest

from cdcmart.catalog.driver_tables import DriverTables
from cdcmart.catalog.queries import run_stream
from cdcmart.operators.changelog import current
from cdcmart.plans import marts, rollups
from cdcmart.session import shared_folder
from cdcmart.streaming import ingest, sinks, state
from helpers import as_set, at, change_table, message, messages, uid


@pytest.fixture
def layout(spark):
    return ingest.Layout(shared_folder(spark, "bounded"))


@pytest.fixture
def nothing_kept(spark, monkeypatch):
    """No table may be kept in the executors' memory."""

    def kept(*_args, **_more):
        raise AssertionError("kept in memory")

    for name in ("persist", "cache"):
        monkeypatch.setattr(type(spark.range(1)), name, kept)


def deviations(spark, first, count, bad=0):
    rows = [{"id": uid(first + n), "protocol_instance_id": uid(n % 3), "step_instance_id": uid(n), "deviation_type": "MISSED", "detected_at": f"2024-0{1 + n % 2}-02T00:00:00Z"} for n in range(count)]
    return messages(spark, *[message("c", r, first + n + 1) for n, r in enumerate(rows)], *["{broken"] * bad)


def test_a_batch_is_kept_nowhere_and_read_once_if_all_is_well(spark, layout, nothing_kept, monkeypatch):
    names = ("mv_deviation_trends", ingest.BY_PATIENT)
    enrolments = change_table(spark, "protocol_instances", *[{"id": uid(n), "patient_id": f"P{n}", "enrolled_at": at("2024-01-01T00:00:00")} for n in range(3)])
    ingest.load(spark, layout, "protocol_instances", enrolments)
    written, real = [], sinks.write_partials
    monkeypatch.setattr(sinks, "write_partials", lambda states, path, batch: (written.append(path), real(states, path, batch)))
    before = spark.conf.get(sinks.SHUFFLE_CLEANUP, "false")
    for n, bad in enumerate((0, 2)):
        ingest.process_batch(deviations(spark, 10 * n, 6, bad), n, ingest.Ingest("deviations", names), layout)
    assert spark.conf.get(sinks.SHUFFLE_CLEANUP) == before
    assert [p.split("/")[-2] for p in written] == ["partials"] * 2 + ["dead_letters"] + ["partials"] * 2
    assert spark.read.parquet(layout.dead("deviations")).count() == 2
    stored = ingest.read_log(spark, layout, "deviations")
    assert stored.count() == 12
    for name in names:
        assert as_set(ingest.read_aggregate(spark, name, layout)) == as_set(marts.build(name, {"deviations": stored, "protocol_instances": enrolments}))


def test_an_unknown_count_of_bad_messages_is_no_zero(spark, layout, monkeypatch):
    monkeypatch.setattr(sinks, "observed", lambda *_: None)
    ingest.process_batch(deviations(spark, 0, 3, bad=1), 0, ingest.Ingest("deviations", ()), layout)
    assert spark.read.parquet(layout.dead("deviations")).count() == 1 and ingest.read_log(spark, layout, "deviations").count() == 3


def test_an_upsert_keeps_nothing_in_memory_or_beside_the_state(spark, layout, nothing_kept):
    kept = state.Kept("inbound_event_logs", "event_time", buckets=3)
    rows = lambda status, days: change_table(spark, "inbound_event_logs", *[{"id": uid(n), "status": status, "received_at": at("2024-01-01T00:00:00"), "event_time": at(f"2024-01-0{1 + n % days}T00:00:00")} for n in range(8)])
    state.upsert(spark, layout, kept, rows("RECEIVED", 2))
    later = rows("ACCEPTED", 3).selectExpr("* EXCEPT (_version)", "_version + 10 AS _version")
    state.upsert(spark, layout, kept, later.union(later.limit(2)))
    found = state.read_current(spark, layout, kept)
    assert {(r.id, r.status) for r in found.collect()} == {(uid(n), "ACCEPTED") for n in range(8)} and found.count() == 8
    assert state.read_current(spark, layout, kept, until=date(2024, 1, 1)).count() == 3
    staged = f"{layout.root}/current_staged".removeprefix("file:")
    assert not os.path.isdir(staged) or os.listdir(staged) == []


LINES = """SELECT cast(id % 40 AS bigint) AS l_orderkey, cast(id % 7 AS bigint) AS l_partkey, cast(id % 11 AS bigint) AS l_suppkey, cast(id % 5 + 1 AS int) AS l_linenumber,
    cast(id % 9 AS double) / 100 AS l_tax, array('N', 'R', 'A')[cast(id % 3 AS int)] AS l_returnflag, if(id % 2 = 0, 'O', 'F') AS l_linestatus,
    date_add(DATE '1998-01-01', cast(id % 90 AS int)) AS l_shipdate FROM range(600)"""


@pytest.mark.parametrize("files", [1, 5])
def test_a_table_arrives_in_batches_without_a_copy_of_its_messages(spark, tmp_path, files):
    spark.sql(LINES).repartition(files).write.parquet(f"{tmp_path}/lineitem.parquet")
    tables = DriverTables(spark, str(tmp_path))
    layout = run_stream(tables, "step_instances", ("rollup_step_current",))
    batches = layout.log(spark).folders("partials/rollup_step_current")
    assert 2 <= len(batches) <= 8
    assert ingest.read_log(spark, layout, "step_instances").count() == 600
    merged = ingest.read_aggregate(spark, "rollup_step_current", layout)
    keys = ("protocol_instance_id", "id")
    assert as_set(merged.select(*keys)) == as_set(current(tables, "step_instances").select(*keys)) and merged.count() == rollups.rollup("rollup_step_current", tables).count()
    below = set(os.listdir(layout.root.removeprefix("file:")))
    assert "messages" not in below and ("given" in below) == (files == 1)
