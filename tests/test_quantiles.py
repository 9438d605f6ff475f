import statistics

import pytest
from pyspark.sql import functions as F

from cdcmart.operators import quantiles
from cdcmart.plans import reports
from helpers import at, tables, uid

RANKS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def test_merged_sketches_stay_within_the_rank_error(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("k"), (F.xxhash64("id") % 100_000).alias("v"), (F.col("id") % 7).alias("batch"))
    parts = [quantiles.quantile_states(rows.where(F.col("batch") == b), ["k", "batch"], "v") for b in range(7)]
    states = parts[0]
    for p in parts[1:]:
        states = states.unionByName(p)
    found = quantiles.read_quantiles(quantiles.merge_quantiles(states, ["k"]), RANKS)
    checked = quantiles.rank_checks(found, rows, ["k"], "v", RANKS).collect()
    assert len(checked) == 3 and all(r.n == 20_000 and r.p50_close and r.p95_close and r.p99_close for r in checked)
    assert all(len(r[quantiles.STATE]) < 20_000 for r in quantiles.merge_quantiles(states, ["k"]).collect())


def test_rank_check_finds_a_wrong_estimate(spark):
    rows = spark.range(1000).select(F.col("id").alias("v"))
    wrong = spark.createDataFrame([(900,)], "p50 long")
    assert quantiles.rank_checks(wrong, rows, [], "v", {"p50": 0.5}).first().p50_close is False


def test_counted_values_give_exact_quantiles_across_slices(spark):
    values = {"a": [3, 3, 3, 10, 5000, -20, 40_000], "b": [7], "c": list(range(0, 20_000, 37))}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("d", None)], "k string, v long")
    counts = quantiles.value_counts(rows, ["k"], "v")
    found = {r.k: r for r in quantiles.quantiles_of_counts(counts, ["k"], "v", RANKS, slice_width=1000).collect()}
    assert set(found) == set(values)
    for k, vs in values.items():
        vs = sorted(vs)
        for name, rank in RANKS.items():
            at_ = (len(vs) - 1) * rank
            low, high = vs[int(at_)], vs[min(int(at_) + (at_ > int(at_)), len(vs) - 1)]
            assert found[k][name] == pytest.approx(low + (high - low) * (at_ - int(at_)))
    assert found["c"].p50 == statistics.median(values["c"])


def test_p95_of_the_look_back_has_no_percentile_buffer_and_a_row_for_nothing(spark):
    none = tables(spark)
    assert reports.e2e_latency_p95_5min(none, "2024-01-01 00:00:00").first().p95 is None
    inbound = [{"id": uid(n), "event_time": at("2024-01-01T00:00:00"), "received_at": at(f"2024-01-01T00:00:{n:02d}")} for n in range(60)]
    some = tables(spark, inbound_event_logs=inbound)
    report = reports.e2e_latency_p95_5min(some, "2024-01-01 00:04:00")
    assert report.first().p95 == pytest.approx(59 * 0.95)
    assert "percentile" not in report._jdf.queryExecution().executedPlan().toString().lower()


def test_states_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "v long")
    states = quantiles.quantile_states(empty, [], "v").where("n > 0")
    assert states.count() == 0
    assert reports.merged_latency_p95(spark.createDataFrame([], "time timestamp, n long, quantile_state binary"), "2024-01-01 00:00:00").count() == 0
