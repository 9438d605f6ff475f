"""Stored tables: layout, idempotent writes, replacement, retention."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cdcmart.fixed_values import LOG_RETENTION_DAYS, RETAINED_TABLES
from cdcmart.functions.columns import as_timestamp, month_of
from cdcmart.operators.changelog import ARRIVAL, latest_by_version
from cdcmart.sources.readers import folder_exists
from cdcmart.sources.schemas import TABLES

BACKFILL = "backfill"
#: Of stored rows and states: a third smaller than with Spark's default.
COMPRESSION = "zstd"
#: Shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_batch(kind: str) -> str:
    """A batch name nobody else uses, in order of time."""
    return f"{kind}-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def _children(spark: SparkSession, path: str) -> list[str]:
    if not folder_exists(spark, path):
        return []
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(status.getPath().getName() for status in files.listStatus(folder))


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Queries that run within leave no shuffle files; for jobs of many writes, of which each would keep its own."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def observed(observation: Observation, name: str, wait_seconds: float = 10) -> int | None:
    """A count that a finished write has observed; None if Spark hasn't told it in time."""
    until = time.monotonic() + wait_seconds
    while time.monotonic() < until:
        found = observation._jo.getOrEmpty()
        if not found.isEmpty():
            return found.apply(name)
    return None


def arrival_of(df: DataFrame) -> Column:
    """Order of arrival of the rows of a batch: now, then the Kafka offset or the order of reading."""
    row = F.col("offset") if "offset" in df.columns else F.monotonically_increasing_id()
    return F.struct(F.lit(time.time_ns()).cast("bigint").alias("at"), row.cast("bigint").alias("row"))


def write_changelog(
    df: DataFrame, path: str, table: str, batch_id: int | str | None = None, bloom_filters: Sequence[str] = ()
) -> None:
    """Append change rows below ``month=.../batch_id=...``.

    Writing a batch again overwrites only its own partitions, so a replayed
    micro-batch leaves one copy; without ``batch_id`` each call is a load under a
    new name, which nothing overwrites. ``rebalance`` lets adaptive execution split
    a month that holds most of the rows and merge the small ones, and the sort
    gives row groups narrow key ranges. ``bloom_filters`` names columns looked
    up by equality (identifiers, status, subject, facility). Rows that do not carry
    an order of arrival yet arrive now.
    """
    batch = new_batch("load") if batch_id is None else str(batch_id)
    spec = TABLES[table]
    month = month_of(F.col(spec.month_column)).cast("int") if spec.month_column else F.lit(0)
    if ARRIVAL not in df.columns:
        df = df.withColumn(ARRIVAL, arrival_of(df))
    placed = df.withColumns({"month": month, "batch_id": F.lit(batch)})
    writer = (
        placed.hint("rebalance", "month")
        .sortWithinPartitions("month", *spec.keys)
        .write.mode("overwrite")
        .option("compression", COMPRESSION)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month", "batch_id")
    )
    for column in bloom_filters:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


def write_partials(states: DataFrame, path: str, batch_id: int | str) -> None:
    """Partial aggregate states of one micro-batch, replaced on replay."""
    (
        states.withColumn("batch_id", F.lit(str(batch_id)))
        .write.mode("overwrite")
        .option("compression", COMPRESSION)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    """Every state below a path that is not kept under a commit log."""
    return spark.read.parquet(path).drop("batch_id")


def append_snapshot(df: DataFrame, path: str) -> None:
    """Add one refresh; readers take the newest ``refreshed_at`` per key."""
    df.write.mode("append").partitionBy("snapshot_date").parquet(path)


def merge_snapshots(spark: SparkSession, path: str, keys: Sequence[str], day: date) -> int:
    """Leave only the newest refresh of each key of one day; returns the rows left.

    The rows go to a folder beside the table first. Rows of refreshes that arrive
    while it runs stay, because only the files that were read are deleted.
    """
    rows = spark.read.parquet(path).where(F.col("snapshot_date") == F.lit(str(day)).cast("date"))
    files = rows.inputFiles()
    newest = latest_by_version(rows, keys, "refreshed_at", deleted=None)
    staged = f"{path}/_merging-{uuid.uuid4().hex}"
    newest.write.parquet(staged)
    kept = spark.read.schema(newest.schema).parquet(staged)
    kept.coalesce(1).write.mode("append").partitionBy("snapshot_date").parquet(path)
    for file in files:
        delete(spark, file)
    left = kept.count()
    delete(spark, staged)
    return left


def replace_table(df: DataFrame, path: str, keep_seconds: int = 3600) -> int:
    """Write a new version beside the old one; readers take the newest complete one.

    A failed write leaves the old version in place; readers never see half. Older
    versions go once the version after them is ``keep_seconds`` old, so that whoever
    reads one can finish.
    """
    version = time.time_ns()
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{path}/data/version={version}")
    complete = _versions(spark, path)
    for old, following in zip(complete, complete[1:], strict=False):
        if following < version - keep_seconds * 10**9:
            delete(spark, f"{path}/data/version={old}")
    return version


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first: a finished Spark write leaves its mark."""
    names = [n for n in _children(spark, f"{path}/data") if n.startswith("version=")]
    return sorted(
        int(n.removeprefix("version=")) for n in names if folder_exists(spark, f"{path}/data/{n}/_SUCCESS")
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version."""
    return spark.read.parquet(f"{path}/data/version={_versions(spark, path)[-1]}")


def backfill(df: DataFrame, path: str) -> None:
    """One-off load of a stored aggregate from history, as a batch of its own
    name; running it again replaces it."""
    write_partials(df, path, BACKFILL)


def apply_retention(
    df: DataFrame, column: str, as_of: datetime | str, days: int = LOG_RETENTION_DAYS
) -> DataFrame:
    """Rows younger than ``days``."""
    return df.where(F.col(column) > as_timestamp(as_of) - F.make_dt_interval(F.lit(days)))


def drop_expired_months(
    spark: SparkSession, path: str, table: str, as_of: date, days: int = LOG_RETENTION_DAYS
) -> list[int]:
    """Remove month partitions that lie wholly before the retention bound.

    Only the log tables with a retention have any; the month of unreadable
    timestamps is left alone.
    """
    if table not in RETAINED_TABLES:
        return []
    keep_from = int((as_of - timedelta(days=days)).strftime("%Y%m"))
    dropped = []
    for name in _children(spark, path):
        if not name.startswith("month="):
            continue
        month = int(name.removeprefix("month="))
        if 197001 < month < keep_from:
            delete(spark, f"{path}/{name}")
            dropped.append(month)
    return sorted(dropped)
