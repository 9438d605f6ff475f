"""Reports over a query log and statement statistics.

``query_log``: event_time, type, user, query, duration_ms, memory, read_rows,
read_bytes, exception_code, exception. Queries are grouped by their shape, the
text with literals replaced. Ties of a top list end in user and shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdcmart.fixed_values import HEAVY_QUERY_BYTES, QUERY_FAILED, QUERY_FINISHED, SYSTEM_QUERY_LIKE
from cdcmart.functions.columns import count_where, query_hash, query_shape, readable_size
from cdcmart.operators.quantiles import merge_quantiles, quantile_states, read_quantiles

SHAPE = "query_shape"


def in_scope(log: DataFrame) -> DataFrame:
    """Everything but queries on system tables."""
    return log.where(~F.col("query").like(SYSTEM_QUERY_LIKE))


def finished(log: DataFrame) -> DataFrame:
    return in_scope(log).where(F.col("type") == QUERY_FINISHED)


def failed(log: DataFrame) -> DataFrame:
    return in_scope(log).where(F.col("type") == QUERY_FAILED)


def _whole(value):
    """Rounded to a whole number; interpolation noise below a millionth is cut
    first, so an exact half is still seen as one."""
    return F.bround(F.round(value, 6), 0)


def _mean_ms():
    return F.bround(F.avg("duration_ms"), 0).alias("avg_ms")


def ql_totals(log: DataFrame) -> DataFrame:
    done = F.col("type") == QUERY_FINISHED
    return in_scope(log).agg(
        count_where(done).alias("finished"),
        count_where(F.col("type") == QUERY_FAILED).alias("failed"),
        F.bround(F.avg(F.when(done, F.col("duration_ms"))), 0).alias("avg_ms"),
    )


def ql_volume_per_minute(log: DataFrame) -> DataFrame:
    return (
        in_scope(log)
        .groupBy(F.date_trunc("MINUTE", "event_time").alias("time"))
        .agg(
            count_where(F.col("type") == QUERY_FINISHED).alias("successful"),
            count_where(F.col("type") == QUERY_FAILED).alias("failed"),
        )
        .orderBy("time")
    )


def ql_latency_percentiles(log: DataFrame) -> DataFrame:
    ranks = F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))
    return (
        finished(log)
        .groupBy(F.date_trunc("MINUTE", "event_time").alias("time"))
        .agg(F.percentile("duration_ms", ranks).alias("_p"))
        .select(
            "time",
            _whole(F.col("_p")[0]).alias("p50_ms"),
            _whole(F.col("_p")[1]).alias("p95_ms"),
            _whole(F.col("_p")[2]).alias("p99_ms"),
        )
        .orderBy("time")
    )


def _shapes(log: DataFrame, *measures) -> DataFrame:
    return (
        log.groupBy(query_shape(F.col("query")).alias(SHAPE), "user")
        .agg(F.min("query").alias("sample_query"), F.count(F.lit(1)).alias("executions"), *measures)
    )


def ql_slowest_shapes(log: DataFrame, top: int = 10) -> DataFrame:
    return (
        _shapes(
            finished(log),
            _mean_ms(),
            F.max("duration_ms").alias("max_ms"),
            _whole(F.percentile("duration_ms", 0.95)).alias("p95_ms"),
            F.max("memory").alias("_peak"),
        )
        .withColumn("peak_mem", readable_size(F.col("_peak")))
        .drop("_peak")
        .orderBy(F.desc("avg_ms"), "user", SHAPE)
        .limit(top)
    )


QUERY_RANKS = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}


def duration_states(log: DataFrame) -> DataFrame:
    """Stored states of the finished queries of a batch, per minute, shape and user: a quantile sketch of their
    durations, and what the list of slowest shapes shows besides."""
    shaped = finished(log).withColumns({"time": F.date_trunc("MINUTE", "event_time"), SHAPE: query_shape(F.col("query"))})
    others = {
        "sample_query": F.min("query"),
        "total_ms": F.sum("duration_ms"),
        "max_ms": F.max("duration_ms"),
        "peak": F.max("memory"),
    }
    return quantile_states(shaped, ["time", SHAPE, "user"], "duration_ms", others)


def merged_latency_percentiles(states: DataFrame) -> DataFrame:
    """Percentiles per minute out of the states of any batches, shapes and users."""
    return read_quantiles(merge_quantiles(states, ["time"]), QUERY_RANKS).orderBy("time")


def merged_slowest_shapes(states: DataFrame, top: int = 10) -> DataFrame:
    """The slowest shapes out of the states of any batches and minutes."""
    others = {"sample_query": F.min("sample_query"), "total_ms": F.sum("total_ms"), "max_ms": F.max("max_ms"), "peak": F.max("peak")}
    merged = read_quantiles(merge_quantiles(states, [SHAPE, "user"], others), {"p95_ms": 0.95})
    return (
        merged.withColumns({"avg_ms": F.bround(F.col("total_ms") / F.col("n"), 0), "peak_mem": readable_size(F.col("peak"))})
        .withColumnRenamed("n", "executions")
        .drop("total_ms", "peak")
        .orderBy(F.desc("avg_ms"), "user", SHAPE)
        .limit(top)
    )


def ql_by_hash(log: DataFrame) -> DataFrame:
    """Finished queries by the hash of their shape, with the shape and how many shapes share the hash."""
    hashed = finished(log).withColumn("_hash", query_hash(F.col("query")))
    grouped = hashed.groupBy("_hash").agg(
        F.min(query_shape(F.col("query"))).alias(SHAPE),
        F.count_distinct(query_shape(F.col("query"))).alias("shapes"),
        F.count(F.lit(1)).alias("executions"),
        F.sum("duration_ms").alias("total_ms"),
    )
    return grouped.drop("_hash")


def ql_memory_shapes(log: DataFrame, top: int = 10) -> DataFrame:
    return (
        _shapes(finished(log), F.sum("memory").alias("_total"), F.max("memory").alias("_peak"), _mean_ms())
        .orderBy(F.desc("_total"), "user", SHAPE)
        .limit(top)
        .withColumns({"total_mem": readable_size(F.col("_total")), "peak_mem": readable_size(F.col("_peak"))})
        .drop("_total", "_peak")
    )


def ql_read_volume_shapes(log: DataFrame, top: int = 10) -> DataFrame:
    return (
        _shapes(
            finished(log),
            F.sum("read_bytes").alias("_bytes"),
            F.sum("read_rows").alias("total_read_rows"),
            _mean_ms(),
        )
        .orderBy(F.desc("_bytes"), "user", SHAPE)
        .limit(top)
        .withColumn("total_read_bytes", readable_size(F.col("_bytes")))
        .drop("_bytes")
    )


def ql_recent_errors(log: DataFrame, top: int = 20) -> DataFrame:
    return (
        failed(log)
        .select("event_time", "user", "query", "exception")
        .orderBy(F.desc("event_time"), "user", "query")
        .limit(top)
    )


def ql_by_user(log: DataFrame) -> DataFrame:
    return (
        finished(log)
        .groupBy("user")
        .agg(F.count(F.lit(1)).alias("queries"), _mean_ms(), readable_size(F.sum("memory")).alias("total_mem"))
        .orderBy(F.desc("queries"), "user")
    )


def ql_error_breakdown(log: DataFrame, top: int = 15) -> DataFrame:
    return (
        failed(log)
        .groupBy("exception_code")
        .agg(F.min("exception").alias("message"), F.count(F.lit(1)).alias("occurrences"))
        .orderBy(F.desc("occurrences"), "exception_code")
        .limit(top)
    )


def ql_over_memory(log: DataFrame, limit_bytes: int = HEAVY_QUERY_BYTES, top: int = 10) -> DataFrame:
    """Shapes with runs above the memory limit, finished or not."""
    return (
        _shapes(in_scope(log).where(F.col("memory") > limit_bytes), F.max("memory").alias("_peak"), _mean_ms())
        .withColumnRenamed("executions", "hits")
        .orderBy(F.desc("_peak"), "user", SHAPE)
        .limit(top)
        .withColumn("max_mem", readable_size(F.col("_peak")))
        .drop("_peak")
    )


def ql_cache_candidates(log: DataFrame, more_than: int = 5, top: int = 10) -> DataFrame:
    return (
        _shapes(finished(log), _mean_ms(), F.sum("memory").alias("_total"))
        .where(F.col("executions") > more_than)
        .orderBy(F.desc("executions"), "user", SHAPE)
        .limit(top)
        .withColumn("total_mem", readable_size(F.col("_total")))
        .drop("_total")
    )


def stmt_totals(statements: DataFrame) -> DataFrame:
    """Distinct statements, calls, slowest mean, cache hits in per cent."""
    blocks = F.sum("blks_hit") + F.sum("blks_read")
    hits = F.bround(F.sum("blks_hit").cast("double") / F.nullif(blocks.cast("double"), F.lit(0.0)) * 100, 2)
    return statements.agg(
        F.count(F.lit(1)).alias("statements"),
        F.sum("calls").alias("calls"),
        F.bround(F.max("mean_exec_time"), 2).alias("slowest_mean_ms"),
        hits.alias("cache_hit_pct"),
    )


STATEMENT_ORDERS = ("mean_exec_time", "total_exec_time", "calls", "rows")


def stmt_top10(statements: DataFrame, by: str, top: int = 10) -> DataFrame:
    """The top statements by mean time, total time, calls or rows."""
    if by not in STATEMENT_ORDERS:
        raise ValueError(f"order by one of {STATEMENT_ORDERS}, not {by!r}")
    return (
        statements.orderBy(F.desc(by), "query")
        .limit(top)
        .select(
            "query",
            "calls",
            F.bround("mean_exec_time", 2).alias("avg_ms"),
            F.bround("min_exec_time", 2).alias("min_ms"),
            F.bround("max_exec_time", 2).alias("max_ms"),
            F.bround("total_exec_time", 2).alias("total_ms"),
            "rows",
        )
    )


def gauge_series(samples: DataFrame, metric: str, low, high) -> DataFrame:
    """A gauge over time between two bounds."""
    within = F.col("ts").between(F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp"))
    return (
        samples.where((F.col("metric") == metric) & within)
        .select(F.col("ts").alias("time"), "labels", "value")
        .orderBy("time")
    )
