from datetime import date, datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cdcmart.operators import asof
from cdcmart.sources.readers import date_series
from helpers import as_set

FIRST, LAST = date(2024, 1, 5), date(2024, 1, 12)
few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
moves = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 24 * 14), st.sampled_from("ABC")), min_size=1, max_size=20)


def days():
    return [FIRST + timedelta(d) for d in range((LAST - FIRST).days + 1)]


def history_of(spark, given):
    rows = [(i, e, s, datetime(2024, 1, 1) + timedelta(hours=h)) for i, (e, h, s) in enumerate(given)]
    return rows, spark.createDataFrame(rows, "id long, entity int, status string, changed_at timestamp")


@few
@given(given_moves=moves)
def test_states_equal_the_day_by_day_definition(spark, given_moves):
    rows, df = history_of(spark, given_moves)
    want = set()
    for day in days():
        for entity in {r[1] for r in rows}:
            seen = [r for r in rows if r[1] == entity and r[3].date() <= day]
            if seen:
                want.add((entity, day, max(seen, key=lambda r: (r[3], r[0]))[2]))
    redelivered = df.unionAll(df.limit(3))
    assert as_set(asof.asof_states(redelivered, "entity", ["status"], FIRST, LAST)) == want


@few
@given(given_moves=moves)
def test_counts_equal_the_day_by_day_definition(spark, given_moves):
    rows, df = history_of(spark, given_moves)
    want = set()
    for day in days():
        for entity in {r[1] for r in rows}:
            seen = [r for r in rows if r[1] == entity and r[3].date() <= day]
            if seen:
                want.add((sum(r[2] == "A" for r in seen), entity, len(seen), day))
    kinds = {"n": F.lit(True), "a": F.col("status") == "A"}
    assert as_set(asof.asof_event_counts(df, "entity", "changed_at", kinds, FIRST, LAST)) == want


def test_running_totals_repeat_over_quiet_days(spark):
    deltas = spark.createDataFrame([("p", FIRST, 2), ("p", FIRST, 1), ("p", date(2024, 1, 8), -1), ("q", LAST, 5)], "k string, snapshot_date date, n int")
    got = as_set(asof.cumulative_by_day(deltas, ["k"], ["n"], LAST))
    want = {("p", 3 if d < date(2024, 1, 8) else 2, d) for d in days()} | {("q", 5, LAST)}
    assert got == want


def test_date_series_has_both_ends(spark):
    assert {r[0] for r in date_series(spark, FIRST, LAST).collect()} == set(days())
