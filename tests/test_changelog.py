import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cdcmart.fixed_values import UNAVAILABLE_VALUE
from cdcmart.operators import changelog as c
from helpers import as_dicts, as_set

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
change = st.tuples(st.integers(0, 4), st.integers(1, 50), st.booleans())
DDL = "id int, _version long, value string, _is_deleted boolean"


def rows_from(changes):
    """Distinct versions, as a log has."""
    return [(key, i + 1, f"v{n}-{i}", gone) for i, (key, n, gone) in enumerate(changes)]


def expected(rows):
    last = {}
    for key, version, value, gone in sorted(rows, key=lambda r: r[1]):
        last[key] = (version, value, gone)
    return {(gone, version, key, value) for key, (version, value, gone) in last.items() if not gone}


def build(spark, rows):
    return spark.createDataFrame(rows or [(0, 0, "", True)], DDL)


@few
@given(changes=st.lists(change, max_size=25), seed=st.integers(0, 99))
def test_latest_is_independent_of_order_and_idempotent(spark, changes, seed):
    rows = rows_from(changes)
    shuffled = rows + rows[: len(rows) // 2]
    random.Random(seed).shuffle(shuffled)
    latest = c.latest_by_version(build(spark, shuffled))
    assert as_set(latest) == expected(rows)
    assert as_set(c.latest_by_version(latest)) == expected(rows)


@few
@given(changes=st.lists(change, min_size=1, max_size=25), cut=st.integers(0, 25))
def test_merged_partials_equal_latest_for_any_batching(spark, changes, cut):
    rows = rows_from(changes)
    df = build(spark, rows).withColumnRenamed("_is_deleted", "is_deleted")
    first, second = df.where(F.col("_version") <= cut), df.where(F.col("_version") > cut)
    states = c.argmax_partial(first, ["id"], ["value", "is_deleted"]).unionByName(
        c.argmax_partial(second, ["id"], ["value", "is_deleted"])
    )
    assert as_set(c.argmax_merge(states, ["id"]).select("id", "value")) == {(k, v) for _, _, k, v in expected(rows)}


def test_argmax_can_skip_null(spark):
    df = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, None, "y"), (2, 1, None, "z")], "id int, _version long, note string, s string")
    states = c.argmax_partial(df, ["id"], ["s", "note"], skip_null=["note"])
    assert as_set(c.argmax_merge(states, ["id"]).select("id", "note", "s")) == {(1, "a", "y"), (2, None, "z")}


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_carry_forward_over_slices(spark, width):
    marker = UNAVAILABLE_VALUE
    values = ["a", marker, marker, None, "b", marker, marker, marker]
    rows = [(1, v, x) for v, x in enumerate(values, 1)] + [(2, 1, marker), (2, 2, "z"), (2, 9, marker)]
    df = spark.createDataFrame(rows, "id int, _version long, big string")
    got = c.carry_forward_unavailable(df, ["big"], F.floor(F.col("_version") / width))
    by_key = {(r["id"], r["_version"]): r["big"] for r in as_dicts(got)}
    assert [by_key[1, v] for v in range(1, 9)] == ["a", "a", "a", "a", "b", "b", "b", "b"]
    assert [by_key[2, v] for v in (1, 2, 9)] == [None, "z", "z"]


def test_running_total_over_slices(spark):
    rows = [(k, t, k + t) for k in (1, 2) for t in range(20)]
    df = spark.createDataFrame(rows, "k int, t int, x int")
    got = c.running_total(df, ["k"], ["t"], F.floor(F.col("t") / 6), {"total": F.col("x")})
    for r in as_dicts(got):
        assert r["total"] == sum(r["k"] + t for t in range(r["t"] + 1))


def test_additive_partials_and_states(spark):
    df = spark.createDataFrame([("a", i % 700, "n") for i in range(3000)] + [("b", 1, "m")], "d string, p int, name string")
    half = df.withColumn("h", F.monotonically_increasing_id() % 2)

    def states(rows):
        return rows.groupBy("d").agg(
            F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("p").alias("patients"), F.min("name").alias("name")
        )

    both = states(half.where("h = 0")).unionByName(states(half.where("h = 1")))
    merged = {r["d"]: r for r in as_dicts(c.state_merge(both, ["d"], ["n"], ["patients"], ["name"]))}
    assert merged["a"]["n"] == 3000 and abs(merged["a"]["patients"] - 700) <= 35
    assert merged["b"] == {"d": "b", "n": 1, "patients": 1, "name": "m"}
    assert as_set(c.sum_merge(both.select("d", "n"), ["d"], ["n"])) == {("a", 3000), ("b", 1)}


def test_a_hot_key_is_reduced_before_the_exchange(spark):
    df = spark.range(10_000).selectExpr("id % 3 AS id", "id AS _version", "false AS _is_deleted")
    plan = c.latest_by_version(df)._jdf.queryExecution().executedPlan().toString()
    limit, exchange = plan.index("row_number(), 1, Partial"), plan.index("Exchange hashpartitioning")
    assert exchange < limit  # printed top down: the partial limit sits below the exchange
