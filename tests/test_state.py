from datetime import date

import pytest

from cdcmart.operators.changelog import Resolved, latest_by_version
from cdcmart.plans import kpis
from cdcmart.session import shared_folder
from cdcmart.streaming import ingest, state
from cdcmart.streaming.commits import Conflict
from helpers import as_set, at, change_table, tables, uid

NAME = "inbound_event_logs"


@pytest.fixture
def layout(spark):
    return ingest.Layout(shared_folder(spark, "state-test"))


def event(n, version, day="2024-01-05", **more):
    return {"id": uid(n), "cloudevents_id": f"ce{n}", "status": "ACCEPTED", "event_time": at(f"{day}T10:00:00") if day else None, "_version": version, **more}


def test_upserts_equal_the_changelog_and_touch_only_their_days(spark, layout):
    kept = state.Kept(NAME, "event_time", buckets=8)
    waves = [
        [event(n, 10 + n, f"2024-01-{1 + n % 9:02d}") for n in range(40)] + [event(50, 1, None)],
        [event(3, 100, "2024-01-04", status="REJECTED")],
        [event(4, 101, "2024-02-20"), event(5, 2, "2024-01-06", status="OLD")],  # one moves, one is older than what is stored
        [event(6, 102, "2024-01-07", _is_deleted=True), event(50, 103, None, _is_deleted=True)],
        [event(6, 90, "2024-01-07"), event(7, 104, "2024-01-08"), event(7, 105, "2024-01-08", status="LAST")],  # an old version of a deleted key
    ]
    changes, replaced = None, []
    for wave in waves:
        rows = change_table(spark, NAME, *wave)
        changes = rows if changes is None else changes.unionByName(rows)
        replaced.append([f.split("/")[0] for f in state.upsert(spark, layout, kept, rows)])
        assert as_set(state.read_current(spark, layout, kept)) == as_set(latest_by_version(changes))
    assert replaced[0] == [] and replaced[1] == ["day=2024-01-04"] and replaced[2] == ["day=2024-01-05"]
    assert sorted(replaced[3]) == ["day=1970-01-01", "day=2024-01-07"] and replaced[4] == ["day=2024-01-08"]
    assert state.upsert(spark, layout, kept, rows) == []  # nothing newer
    assert as_set(state.read_current(spark, layout, kept)) == as_set(latest_by_version(changes))


def test_a_window_reads_its_days_only(spark, layout):
    kept = state.Kept(NAME, "event_time")
    state.upsert(spark, layout, kept, change_table(spark, NAME, *[event(n, n + 1, f"2024-01-{1 + n:02d}") for n in range(20)]))
    window = state.read_current(spark, layout, kept, date(2024, 1, 10), date(2024, 1, 12))
    assert window.count() == 3 and len(window.inputFiles()) == 3
    assert "day" in window._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_kpis_from_state_have_no_deduplication(spark, layout):
    kept = state.Kept(NAME, "event_time")
    given = tables(spark, inbound_event_logs=[event(n, n + 1, facility_id="f") for n in range(5)] + [event(0, 50, status="REJECTED")])
    state.upsert(spark, layout, kept, given[NAME])
    resolved = Resolved(given, {NAME: state.read_current(spark, layout, kept, date(2023, 6, 1))})
    as_of = "2024-02-01 00:00:00"
    report = kpis.mv_daily_adoption_kpis(resolved, as_of)
    assert as_set(kpis.mv_daily_event_kpis(resolved, as_of)) == as_set(kpis.mv_daily_event_kpis(given, as_of))
    windows = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Window [")
    assert windows(report) == 1 and windows(kpis.mv_daily_adoption_kpis(given, as_of)) == 2  # of the roster, and of the events


def test_an_upsert_that_stops_or_meets_another_leaves_the_state(spark, layout):
    kept = state.Kept(NAME, "event_time", buckets=2)
    first = change_table(spark, NAME, event(1, 1), event(2, 2))
    state.upsert(spark, layout, kept, first)
    second = change_table(spark, NAME, event(1, 3, status="NEW"))
    third = change_table(spark, NAME, event(2, 4, status="OTHER"))
    with pytest.raises(Conflict):
        state.upsert(spark, layout, kept, second, before_commit=lambda: state.upsert(spark, layout, kept, third))
    assert as_set(state.read_current(spark, layout, kept).select("id", "status")) == {(uid(1), "ACCEPTED"), (uid(2), "OTHER")}
    state.upsert(spark, layout, kept, second)
    assert as_set(state.read_current(spark, layout, kept).select("id", "status")) == {(uid(1), "NEW"), (uid(2), "OTHER")}
    assert state.read_current(spark, layout, state.Kept("deviations", "detected_at")).count() == 0
