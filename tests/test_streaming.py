import random
from datetime import date, timedelta

import pytest

from cdcmart.operators.changelog import latest_by_version
from cdcmart.plans import kpis, marts, rollups
from cdcmart.session import shared_folder
from cdcmart.sources.envelope import decode_envelope
from cdcmart.sources.readers import read_change_files, read_changelog
from cdcmart.streaming import ingest, sinks
from cdcmart.streaming.commits import Conflict
from helpers import as_set, at, change_table, message, tables, uid


@pytest.fixture
def layout(spark):
    return ingest.Layout(shared_folder(spark, "test"))


def deviation_messages():
    values = []
    for n in range(30):
        row = {"id": uid(n), "protocol_instance_id": uid(n % 4), "step_instance_id": uid(n % 7), "deviation_type": ["OVERDUE", "MISSED"][n % 2],
               "detected_at": f"2024-0{1 + n % 3}-0{1 + n % 5}T10:00:00Z"}
        values.append(message("c", row, n * 3 + 1))
        if n % 5 == 0:
            values.append(message("u", {**row, "metadata": "{}"}, n * 3 + 2))
        if n % 6 == 0:
            values.append(message("d", row, n * 3 + 3))
    values.append("{broken")
    return values


def write_files(spark, layout, values, files):
    random.Random(3).shuffle(values)
    folder = f"{layout.root}/messages"
    for i in range(files):
        spark.createDataFrame([(v,) for v in values[i::files]], "value string").coalesce(1).write.mode("append").text(folder)
    return folder


def run(spark, folder, layout, table="deviations"):
    query = ingest.start_ingest(
        read_change_files(spark, folder, files_per_batch=1), ingest.Ingest.everything(table), layout, {"availableNow": True}
    )
    query.awaitTermination()


def test_stream_equals_batch_and_replay_changes_nothing(spark, layout):
    enrolments = change_table(spark, "protocol_instances", *[{"id": uid(n), "patient_id": f"P{n}", "protocol_definition_id": uid(9),
                                                             "enrolled_at": at("2024-01-01T00:00:00")} for n in range(3)])
    ingest.load(spark, layout, "protocol_instances", enrolments)
    folder = write_files(spark, layout, deviation_messages(), 3)
    run(spark, folder, layout)
    changes = decode_envelope(spark.read.text(folder), "deviations")
    batch = {"deviations": changes, "protocol_instances": enrolments}

    def check():
        stored = ingest.read_log(spark, layout, "deviations")
        assert stored.count() == changes.count()
        assert as_set(latest_by_version(stored)) == as_set(latest_by_version(changes))
        for name in ("mv_deviation_trends", "mv_deviation_by_protocol", "mv_deviation_by_patient"):
            assert as_set(ingest.read_aggregate(spark, name, layout)) == as_set(marts.build(name, batch)), name
        assert len(layout.log(spark).folders("dead_letters/deviations")) == 1

    check()
    batches = layout.log(spark).folders("partials/mv_deviation_trends")
    assert len(batches) >= 3
    # The same batch delivered again, under its own id.
    names = [f.path for f in spark.read.format("binaryFile").load(f"{folder}/*.txt").select("path").collect()]
    replay = Ingested(spark, layout, "again")
    replay.batch(names[0], 7)
    once = as_set(ingest.read_aggregate(spark, "mv_deviation_trends", replay.layout))
    replay.batch(names[0], 7)
    assert as_set(ingest.read_aggregate(spark, "mv_deviation_trends", replay.layout)) == once
    check()


class Ingested:
    def __init__(self, spark, layout, name):
        self.spark, self.layout = spark, ingest.Layout(f"{layout.root}/{name}")

    def batch(self, path, batch_id):
        only = ingest.Ingest("deviations", ("mv_deviation_trends",))
        ingest.process_batch(self.spark.read.text(path), batch_id, only, self.layout)


def test_a_late_parent_is_repaired_by_batch_only(spark, layout):
    early = change_table(spark, "protocol_instances", {"id": uid(1), "patient_id": "P1", "protocol_definition_id": uid(9),
                                                      "enrolled_at": at("2024-01-01T00:00:00")})
    late = change_table(spark, "protocol_instances", {"id": uid(0), "patient_id": "P0", "protocol_definition_id": uid(9),
                                                     "enrolled_at": at("2024-01-01T00:00:00")})
    ingest.load(spark, layout, "protocol_instances", early)
    rows = [{"id": uid(n), "protocol_instance_id": uid(n % 2), "deviation_type": "MISSED", "detected_at": at("2024-01-02T00:00:00")} for n in range(4)]
    changes = change_table(spark, "deviations", *rows)
    states = ingest.batch_states(spark, ingest.BY_PATIENT, changes, layout)
    ingest.store_states(spark, layout, ingest.BY_PATIENT, states)
    ingest.load(spark, layout, "protocol_instances", late)
    streamed = {(r.patient_id, r.deviation_count) for r in ingest.read_aggregate(spark, ingest.BY_PATIENT, layout).collect()}
    assert streamed == {("", 2), ("P1", 2)}
    batch = marts.build("mv_deviation_by_patient", {"deviations": changes, "protocol_instances": early.unionByName(late)})
    assert {(r.patient_id, r.deviation_count) for r in batch.collect()} == {("P0", 2), ("P1", 2)}


def delivery(n, status, version, when="2024-01-05T00:00:00", **more):
    return {"id": uid(n), "status": status, "destination": "d", "created_at": at(when), "_version": version, **more}


def test_month_pruning_retention_and_compaction(spark, layout):
    path = layout.changelog("intelligence_deliveries")
    first = change_table(spark, "intelligence_deliveries", delivery(1, "PENDING", 1), delivery(2, "PENDING", 2), delivery(3, "PENDING", 3, "2023-06-01T00:00:00"))
    second = change_table(spark, "intelligence_deliveries", delivery(1, "DELIVERED", 4), delivery(2, "FAILED", 5, _is_deleted=True))
    sinks.write_changelog(first, path, "intelligence_deliveries", 1)
    sinks.write_changelog(second, path, "intelligence_deliveries", 2)
    sinks.write_changelog(second, path, "intelligence_deliveries", 2)
    stored = read_changelog(spark, path, "intelligence_deliveries")
    assert stored.count() == 5
    pruned = read_changelog(spark, path, "intelligence_deliveries", since=date(2024, 1, 1))
    assert pruned.count() == 4
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    other = ingest.Layout(f"{layout.root}/committed")
    for rows in (first, second):
        ingest.load(spark, other, "intelligence_deliveries", rows)
    pruned = ingest.read_log(spark, other, "intelligence_deliveries", since=date(2024, 1, 1))
    assert pruned.count() == 4 and len(pruned.inputFiles()) < len(ingest.read_log(spark, other, "intelligence_deliveries").inputFiles())
    ingest.compact(spark, other, "intelligence_deliveries", 202401)
    compacted = ingest.read_log(spark, other, "intelligence_deliveries")
    assert {(r.id, r.status, r._is_deleted) for r in compacted.collect()} == {
        (uid(1), "DELIVERED", False), (uid(2), "FAILED", True), (uid(3), "PENDING", False)
    }
    # retention holds on reading, before and after the months are dropped
    assert ingest.read_log(spark, other, "intelligence_deliveries", as_of=at("2024-02-01T00:00:00")).count() == 2
    assert [f.split("/")[0] for f in ingest.expire(spark, other, "intelligence_deliveries", date(2024, 2, 1))] == ["month=202306"]
    assert ingest.read_log(spark, other, "intelligence_deliveries").count() == 2 and ingest.expire(spark, other, "facility", date(2024, 2, 1)) == []
    assert sinks.drop_expired_months(spark, path, "intelligence_deliveries", date(2024, 2, 1)) == [202306]
    assert read_changelog(spark, path, "intelligence_deliveries").count() == 4
    assert sinks.drop_expired_months(spark, path, "facility", date(2024, 2, 1)) == []
    kept = sinks.apply_retention(first, "created_at", "2024-01-31 00:00:00")
    assert {r.id for r in kept.collect()} == {uid(1), uid(2)}


def test_replacing_and_appending_refreshes(spark, layout):
    def compute(moment):
        return kpis.mv_daily_compliance_kpis(
            tables(spark, protocol_instances=[{"id": uid(1), "protocol_definition_id": uid(9), "status": "ACTIVE"}]), moment
        )

    for minute in (0, 1):
        ingest.refresh_once(compute, f"{layout.root}/kpi", append=True, as_of=at(f"2024-01-05T00:0{minute}:00"))
        ingest.refresh_once(compute, f"{layout.root}/whole", append=False, as_of=at(f"2024-01-05T00:0{minute}:00"))
    stored = spark.read.parquet(f"{layout.root}/kpi")
    assert stored.count() == 2
    (newest,) = kpis.snapshot_latest(stored, "mv_daily_compliance_kpis").collect()
    assert newest.refreshed_at == at("2024-01-05T00:01:00")
    (whole,) = sinks.read_table(spark, f"{layout.root}/whole").collect()
    assert whole.refreshed_at == at("2024-01-05T00:01:00")


def test_scheduled_refresh_runs(spark, layout):
    done = []

    def compute(moment):
        done.append(moment)
        return spark.createDataFrame([(1, moment)], "n int, refreshed_at timestamp")

    query = ingest.start_refresh(spark, compute, f"{layout.root}/kpi", False, layout.checkpoint("refresh"), every="1 second")
    try:
        for _ in range(60):
            if len(done) >= 2 or not query.isActive:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert len(done) >= 2 and sinks.read_table(spark, f"{layout.root}/kpi").count() == 1


def test_rebuild_doubles_nothing_and_streams_go_on(spark, layout):
    rows = [{"id": uid(n), "deviation_type": "MISSED", "detected_at": at("2024-01-02T00:00:00")} for n in range(5)]
    snapshot = {"deviations": change_table(spark, "deviations", *rows)}
    total = lambda: [r.deviation_count for r in ingest.read_aggregate(spark, "mv_deviation_trends", layout).collect()]
    only = ingest.Ingest("deviations", ("mv_deviation_trends",))
    arrive = lambda n: ingest.process_batch(spark.createDataFrame([(message("c", {"id": uid(50 + n), "protocol_instance_id": uid(1), "step_instance_id": uid(2), "deviation_type": "MISSED", "detected_at": "2024-01-02T00:00:00Z"}, 90),)], "value string"), n, only, layout)
    for _ in range(2):
        ingest.rebuild(spark, layout, snapshot)
        assert total() == [5]
    arrive(0)
    assert total() == [6]
    ingest.rebuild(spark, layout, snapshot, before_commit=lambda: arrive(1))  # the first arrival is not in the snapshot, the second comes meanwhile
    assert total() == [6]
    arrive(1)
    assert total() == [6] and ingest.read_log(spark, layout, "deviations").count() == 6


def test_backfill_is_idempotent(spark, layout):
    mart = marts.MARTS["mv_deviation_trends"]
    changes = change_table(spark, "deviations", {"id": uid(1), "deviation_type": "MISSED", "detected_at": at("2024-01-02T00:00:00")})
    for _ in range(2):
        sinks.backfill(marts.partials(changes, mart), f"{layout.root}/p")
    assert [r.deviation_count for r in marts.merge(sinks.read_partials(spark, f"{layout.root}/p"), mart).collect()] == [1]


def test_streaming_dedup_keeps_late_and_unreadable_rows(spark, layout):
    def row(n, moment):
        return message("c", {"id": n, "protocol_instance_id": uid(1), "status": "ACTIVE", "changed_at": moment}, n + 1)

    folder = f"{layout.root}/messages"
    waves = [[row(1, "2024-06-01T00:00:00Z")] * 2, [row(2, "2020-01-01T00:00:00Z"), row(3, "garbage")], [row(1, "2024-06-01T00:00:00Z"), row(3, "garbage")]]
    path = f"{layout.root}/rows"
    for wave in waves:
        spark.createDataFrame([(v,) for v in wave], "value string").coalesce(1).write.mode("append").text(folder)
        changes = decode_envelope(read_change_files(spark, folder, 1), "protocol_instance_history")
        ingest.start_dedup(changes, "protocol_instance_history", "changed_at", timedelta(days=30), path, f"{layout.root}/checkpoint", {"availableNow": True}).awaitTermination()
    stored = read_changelog(spark, path, "protocol_instance_history")
    assert sorted(r.id for r in stored.collect()) == [1, 2, 3]


def test_streaming_buckets(spark, layout):
    rows = [message("c", {"id": n, "protocol_instance_id": uid(1), "status": "ACTIVE", "changed_at": f"2024-01-01T0{n % 3}:10:00Z"}, n) for n in range(6)]
    folder = write_files(spark, layout, rows, 2)
    changes = decode_envelope(read_change_files(spark, folder, 1), "protocol_instance_history")
    buckets = ingest.count_by_bucket(changes, "changed_at", "1 hour")
    query = buckets.writeStream.format("memory").queryName("buckets").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.rows for r in spark.table("buckets").collect()} == {2}


def test_compaction_keeps_batches_that_arrive_meanwhile_and_later_loads(spark, layout):
    name = "intelligence_deliveries"
    wave = lambda first, last: change_table(spark, name, *[delivery(n, "PENDING", n) for n in range(first, last)])
    store = lambda *part: ingest.load(spark, layout, name, wave(*part))
    rows = lambda: ingest.read_log(spark, layout, name).count()
    store(0, 10)
    store(10, 20)
    assert len(ingest.compact(spark, layout, name, 202401, before_commit=lambda: store(20, 45))) == 2
    for part in ((45, 50), (50, 60)):
        store(*part)
    assert rows() == 60
    ingest.compact(spark, layout, name, 202401)
    assert rows() == 60 and ingest.compact(spark, layout, name, 202401) == []


class Stop(Exception):
    pass


def stop():
    raise Stop


def test_a_job_that_stops_between_any_two_writes_changes_no_count(spark, layout, monkeypatch):
    name, aggregate = "deviations", "mv_deviation_trends"
    only = ingest.Ingest(name, (aggregate, "mv_deviation_by_protocol"))
    values = lambda n: spark.createDataFrame([(message("c", {"id": uid(n), "protocol_instance_id": uid(1), "step_instance_id": uid(2), "deviation_type": "MISSED", "detected_at": "2024-01-02T00:00:00Z"}, n + 1),), ("{broken",)], "value string")

    def counts():
        changes = ingest.read_log(spark, layout, name).count()
        totals = [sum(r.deviation_count for r in ingest.read_aggregate(spark, a, layout).collect()) for a in only.aggregates]
        dead = len(layout.log(spark).folders(f"dead_letters/{name}"))
        return changes, *totals, dead

    assert counts() == (0, 0, 0, 0)
    for n in range(2):
        ingest.process_batch(values(n), n, only, layout)
    assert counts() == (2, 2, 2, 2)
    writes = {"n": 0}
    for broken_at in range(4):  # before the dead letters, the changelog, each aggregate
        for writer in ("write_partials", "write_changelog"):
            real = getattr(sinks, writer)

            def counted(*args, real=real, **more):
                writes["n"] += 1
                if writes["n"] == broken_at + 1:
                    raise Stop
                return real(*args, **more)

            monkeypatch.setattr(sinks, writer, counted)
        writes["n"] = 0
        with pytest.raises(Stop):
            ingest.process_batch(values(2), 2, only, layout)
        monkeypatch.undo()
        assert counts() == (2, 2, 2, 2)
    for job in (lambda: ingest.merge_aggregate(spark, aggregate, layout, before_commit=stop), lambda: ingest.compact(spark, layout, name, 202401, before_commit=stop),
                lambda: ingest.rebuild(spark, layout, {name: ingest.read_log(spark, layout, name)}, before_commit=stop)):
        with pytest.raises(Stop):
            job()
        assert counts() == (2, 2, 2, 2)
    for _ in range(2):  # delivered twice
        ingest.process_batch(values(2), 2, only, layout)
    assert counts() == (3, 3, 3, 3)
    assert len(ingest.merge_aggregate(spark, aggregate, layout)) == 3 and len(ingest.compact(spark, layout, name, 202401)) == 3
    assert counts() == (3, 3, 3, 3)
    assert len(ingest.vacuum(spark, layout, keep_seconds=0)) > 8 and counts() == (3, 3, 3, 3)


def test_of_two_mergers_one_is_refused(spark, layout):
    name, aggregate = "deviations", "mv_deviation_trends"
    changes = change_table(spark, name, {"id": uid(1), "deviation_type": "MISSED", "detected_at": at("2024-01-02T00:00:00")})
    total = lambda: sum(r.deviation_count for r in ingest.read_aggregate(spark, aggregate, layout).collect())
    for _ in range(3):
        ingest.store_states(spark, layout, aggregate, marts.partials(changes, marts.MARTS[aggregate]))
        ingest.load(spark, layout, name, changes)
    with pytest.raises(Conflict):
        ingest.merge_aggregate(spark, aggregate, layout, before_commit=lambda: ingest.merge_aggregate(spark, aggregate, layout))
    with pytest.raises(Conflict):
        ingest.compact(spark, layout, name, 202401, before_commit=lambda: ingest.compact(spark, layout, name, 202401))
    assert total() == 3 and ingest.read_log(spark, layout, name).count() == 1


def test_the_log_starts_from_its_summary_and_an_entry_is_created_once(spark, layout):
    log = layout.log(spark)
    for n in range(45):
        assert log.commit({"t": [f"batch_id={n}"]}, {"t": [f"batch_id={n - 1}"]} if n % 2 else None, run="r", batch=n) == n + 1
    assert log.commit({"t": ["again"]}, run="r", batch=44) is None
    state = layout.log(spark).state()
    assert (state.number, state.done, len(state.live["t"])) == (45, {"r": 44}, 23)
    whole = layout.log(spark).state_at(-60)
    assert (whole.live, whole.done) == (state.live, state.done)
    assert not log._create(f"{45:020d}.entry.json", {}) and log._create(f"{46:020d}.entry.json", {"add": {}, "remove": {}, "run": None, "batch": None, "notes": {"a": 1}})
    with pytest.raises(Conflict):
        log.commit({}, expected={"a": 2})
    assert log.commit({}, expected={"a": 1}) == 47


def test_a_new_checkpoint_overwrites_nothing(spark, layout):
    first, second = (ingest.run_of(spark, layout.checkpoint(n)) for n in ("a", "b"))
    assert first != second and ingest.run_of(spark, layout.checkpoint("a")) == first


@pytest.mark.parametrize("partitions", [1, 5])
def test_equal_versions_go_to_the_later_batch(spark, layout, partitions):
    only = ingest.Ingest("intelligence_deliveries", ("rollup_delivery_current",))
    for n, status in enumerate(("PENDING", "DELIVERED")):
        row = {"id": uid(1), "intelligence_event_id": uid(50), "action_definition_id": uid(51), "status": status, "destination": "d", "created_at": "2024-01-05T00:00:00Z"}
        values = [message("c", row, 9)] + [message("c", {**row, "id": uid(2 + i)}, 9) for i in range(6)]
        batch = spark.createDataFrame([(v,) for v in values], "value string").repartition(partitions)
        ingest.process_batch(batch, n, only, layout)
    stored = ingest.read_log(spark, layout, "intelligence_deliveries")
    for rows in (stored, stored.orderBy(stored._arrival.desc()), stored.orderBy("_arrival")):
        assert {r.status for r in latest_by_version(rows).collect()} == {"DELIVERED"}
    assert {r.status for r in ingest.read_aggregate(spark, "rollup_delivery_current", layout).collect()} == {"DELIVERED"}


def test_old_versions_go_after_their_grace(spark, layout):
    path = f"{layout.root}/whole"
    for n in range(3):
        sinks.replace_table(spark.range(n + 1), path, keep_seconds=0)
    assert sinks.read_table(spark, path).count() == 3
    assert len(sinks._versions(spark, path)) <= 2


def test_snapshots_are_merged_to_the_newest_refresh(spark, layout):
    path = f"{layout.root}/snapshots"
    for minute in range(3):
        rows = spark.sql(f"SELECT date'2024-01-05' AS snapshot_date, 'a' AS k, {minute} AS n, timestamp'2024-01-05 00:0{minute}:00' AS refreshed_at")
        sinks.append_snapshot(rows, path)
    assert sinks.merge_snapshots(spark, path, ["snapshot_date", "k"], date(2024, 1, 5)) == 1
    spark.catalog.clearCache()
    assert [r.n for r in spark.read.parquet(path).collect()] == [2]


def test_working_folders(spark):
    assert shared_folder(spark, "x") != shared_folder(spark, "x")
    assert shared_folder(spark, "x", "/shared").startswith("/shared/cdcmart/x-")


def test_every_rollup_and_aggregate_has_a_stream(spark):
    streamed = {a for t in ("inbound_event_logs", "deviations", "intelligence_event_logs", "compliance_event_logs", "protocol_instances",
                            "step_instances", "intelligence_deliveries") for a in ingest.Ingest.everything(t).aggregates}
    assert streamed == set(marts.MART_NAMES) | set(rollups.ROLLUPS)
