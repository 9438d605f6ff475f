"""Current state kept as a table: upserts by key, laid out by day, one commit each.

The rows of a table stand in folders by the day of one of its timestamps, so a window of days reads only its
folders. An index, in ``buckets`` folders by hash of the key, says for each key in which day its row stands and
which version it has. An upsert reads the index folders of its keys, drops what is older than what is stored, and
writes anew only the days that lose or gain a row, and those index folders. Deleted keys stay in the index, so an
old version that comes late brings nothing back. Days and index change in one entry of the commit log;
an upsert that finds a folder replaced by another one is refused and can be run again, and running an upsert
again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cdcmart.operators.changelog import ARRIVAL, DELETED, VERSION, latest_by_version, version_order
from cdcmart.sources.schemas import TABLES
from cdcmart.streaming import sinks
from cdcmart.streaming.commits import Layout, folders_of, read_folders

BUCKETS = 64
#: Day of rows whose timestamp is missing or unreadable.
NO_DAY = date(1970, 1, 1)
_ORDER = "struct<version: bigint, at: bigint, row: bigint>"


@dataclass(frozen=True)
class Kept:
    """A table whose current state is kept, and the timestamp it is laid out by."""

    table: str
    timestamp: str
    buckets: int = BUCKETS

    @property
    def rows(self) -> str:
        return f"current/{self.table}"

    @property
    def index(self) -> str:
        return f"current_index/{self.table}"

    def index_ddl(self) -> str:
        spec = TABLES[self.table]
        kinds = {c: T._parse_datatype_string(spec.stored_ddl())[c].dataType.simpleString() for c in spec.keys}
        keys = ", ".join(f"{k} {t}" for k, t in kinds.items())
        return f"{keys}, _kept_day date, _kept_order {_ORDER}, _kept_gone boolean, bucket int, batch_id string"

    def rows_ddl(self) -> str:
        stored = T._parse_datatype_string(TABLES[self.table].stored_ddl())
        plain = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.fields if f.name != ARRIVAL)
        return f"{plain}, day date, batch_id string"


def upsert(spark: SparkSession, layout: Layout, kept: Kept, changes: DataFrame, before_commit: Callable[[], None] | None = None) -> list[str]:
    """Bring the newest versions of some changes into the stored state; returns the day folders that were replaced."""
    keys = list(TABLES[kept.table].keys)
    log = layout.log(spark)
    live = log.state().live
    rows_path, index_path = f"{layout.root}/{kept.rows}", f"{layout.root}/{kept.index}"
    bucket = F.pmod(F.xxhash64(*keys), F.lit(kept.buckets)).cast("int")
    day = F.coalesce(F.to_date(kept.timestamp), F.lit(NO_DAY))
    batch = sinks.new_batch("upsert")
    staged = f"{layout.root}/current_staged/{kept.table}-{batch}"
    with sinks.shuffles_cleared(spark):
        touched = {f"bucket={r.bucket}" for r in changes.select(bucket.alias("bucket")).distinct().collect()}
        index_folders = [f for f in live.get(kept.index, []) if f.split("/")[0] in touched]
        index = read_folders(spark, index_path, index_folders, kept.index_ddl()).drop("batch_id", "bucket")
        newest = latest_by_version(changes, keys, deleted=None)
        newest = newest.withColumns({"_order": version_order(newest, VERSION), "day": day})
        winners = newest.join(index, keys, "left").where(F.col("_kept_order").isNull() | (F.col("_order") > F.col("_kept_order")))
        try:
            # read four times below: as a compressed table beside the state, nothing of it is kept in memory
            winners.write.option("compression", sinks.COMPRESSION).parquet(staged)
            winners = spark.read.schema(winners.schema).parquet(staged)
            left = winners.where("NOT _kept_gone").select(F.col("_kept_day").alias("day"))
            days = {f"day={r.day}" for r in left.union(winners.where(~F.col(DELETED)).select("day")).distinct().collect()}
            day_folders = [f for f in live.get(kept.rows, []) if f.split("/")[0] in days]
            changed = winners.select(*keys)
            staying = read_folders(spark, rows_path, day_folders, kept.rows_ddl()).drop("batch_id").join(changed, keys, "left_anti")
            arriving = winners.where(~F.col(DELETED)).select(*staying.columns)
            _write(staying.unionByName(arriving), rows_path, batch, "day", keys)
            entries = winners.select(*keys, F.col("day").alias("_kept_day"), F.col("_order").alias("_kept_order"), F.col(DELETED).alias("_kept_gone"))
            _write(index.join(changed, keys, "left_anti").unionByName(entries).withColumn("bucket", bucket), index_path, batch, "bucket", keys)
        finally:
            sinks.delete(spark, staged)
    if before_commit:
        before_commit()
    log.commit(
        {kept.rows: folders_of(spark, rows_path, batch), kept.index: folders_of(spark, index_path, batch)},
        {kept.rows: day_folders, kept.index: index_folders},
    )
    return day_folders


def _write(rows: DataFrame, path: str, batch: str, by: str, keys: list[str]) -> None:
    placed = rows.withColumn("batch_id", F.lit(batch)).hint("rebalance", by).sortWithinPartitions(by, *keys)
    placed.write.mode("append").option("compression", sinks.COMPRESSION).partitionBy(by, "batch_id").parquet(path)


def read_current(spark: SparkSession, layout: Layout, kept: Kept, since: datetime | date | None = None, until: datetime | date | None = None) -> DataFrame:
    """The stored state; ``since`` and ``until`` leave out other days, before any file is opened.

    Rows without a readable timestamp are left out as well if there is a bound.
    """
    low = str(since)[:10] if since else "0000"
    high = str(until)[:10] if until else "9999"
    folders = [f for f in layout.log(spark).folders(kept.rows) if low <= f.split("/")[0].removeprefix("day=") <= high]
    rows = read_folders(spark, f"{layout.root}/{kept.rows}", folders, kept.rows_ddl())
    if since:
        rows = rows.where(F.col("day") >= F.lit(low).cast("date"))
    if until:
        rows = rows.where(F.col("day") <= F.lit(high).cast("date"))
    return rows.drop("batch_id", "day")
