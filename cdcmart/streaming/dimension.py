"""Dimensions with bounded staleness: stored snapshots, renewed by age, read by the keys of a batch.

A snapshot holds a table's keys and some attributes in ``buckets`` folders by hash of the key. It is renewed
when it is older than ``max_age_seconds``: from the changes the commit log has got since, and only in
the buckets these fall into. A lookup reads only the buckets its keys fall into, so a micro-batch neither deduplicates the
table nor reads what it does not need. A key that is new since the last renewal is missing, one that
has changed is as it was; both are put right by the next renewal, never later than the age says.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cdcmart.operators.changelog import DELETED, VERSION, latest_by_version, version_order
from cdcmart.sources.schemas import TABLES
from cdcmart.streaming import sinks
from cdcmart.streaming.commits import GENERATION, Conflict, Layout, folders_of, read_folders


@dataclass(frozen=True)
class Dimension:
    """Attributes of the current rows of a table, by key."""

    name: str
    table: str
    keys: tuple[str, ...]
    attributes: tuple[str, ...]
    max_age_seconds: float = 300
    buckets: int = 64

    @property
    def folder(self) -> str:
        return f"dimensions/{self.name}"

    def ddl(self) -> str:
        stored = T._parse_datatype_string(TABLES[self.table].stored_ddl())
        plain = ", ".join(f"{c} {stored[c].dataType.simpleString()}" for c in (*self.keys, *self.attributes))
        return f"{plain}, _order struct<version: bigint, at: bigint, row: bigint>, _gone boolean, bucket int, batch_id string"

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")


def age(spark: SparkSession, layout: Layout, dimension: Dimension, now: float | None = None) -> float:
    """Seconds since the last renewal; infinite before the first and after a rebuild of the tables."""
    notes = layout.log(spark).state().notes
    note = notes.get(dimension.folder)
    if not note or note["generation"] != notes.get(GENERATION):
        return float("inf")
    return (time.time() if now is None else now) - note["at"]


def renew(spark: SparkSession, layout: Layout, dimension: Dimension, now: float | None = None) -> bool:
    """Renew the snapshot if it is too old; says whether this call has done so.

    Of two renewals at once one counts, which is as new as the other.
    """
    now = time.time() if now is None else now
    if age(spark, layout, dimension, now) < dimension.max_age_seconds:
        return False
    log = layout.log(spark)
    state = log.state()
    note, generation = state.notes.get(dimension.folder), state.notes.get(GENERATION)
    fresh = not note or note["generation"] != generation
    path, keys = f"{layout.root}/{dimension.folder}", list(dimension.keys)
    spec = TABLES[dimension.table]
    arrived = log.added_since(0 if fresh else note["entry"], f"changelog/{dimension.table}")
    changes = read_folders(spark, layout.changelog(dimension.table), arrived, f"{spec.stored_ddl()}, month int, batch_id string")
    newest = latest_by_version(changes, keys, deleted=None)
    newest = newest.select(*keys, *dimension.attributes, version_order(newest, VERSION).alias("_order"), F.col(DELETED).alias("_gone")).withColumn("bucket", dimension.bucket())
    batch = sinks.new_batch("snapshot")
    with sinks.shuffles_cleared(spark):
        live = state.live.get(dimension.folder, [])
        touched = set() if fresh else {f"bucket={r.bucket}" for r in changes.select(dimension.bucket().alias("bucket")).distinct().collect()}
        replaced = live if fresh else [f for f in live if f.split("/")[0] in touched]
        before = read_folders(spark, path, [] if fresh else replaced, dimension.ddl()).drop("batch_id")
        rows = newest if fresh else latest_by_version(before.unionByName(newest), keys, "_order", deleted=None)
        placed = rows.withColumn("batch_id", F.lit(batch)).hint("rebalance", "bucket").sortWithinPartitions("bucket", *keys)
        placed.write.mode("append").option("compression", sinks.COMPRESSION).partitionBy("bucket", "batch_id").parquet(path)
    try:
        log.commit(
            {dimension.folder: folders_of(spark, path, batch)},
            {dimension.folder: replaced},
            notes={dimension.folder: {"at": now, "entry": state.number, "generation": generation}},
            expected={dimension.folder: note, GENERATION: generation},
        )
    except Conflict:
        return False
    return True


def rows_for(spark: SparkSession, layout: Layout, dimension: Dimension, keys: DataFrame | None = None) -> DataFrame:
    """The snapshot's rows in the buckets of the given keys (all rows without keys); deleted ones are not there."""
    folders = layout.log(spark).folders(dimension.folder)
    if keys is not None:
        wanted = {f"bucket={r.bucket}" for r in keys.select(dimension.bucket().alias("bucket")).distinct().collect()}
        folders = [f for f in folders if f.split("/")[0] in wanted]
    rows = read_folders(spark, f"{layout.root}/{dimension.folder}", folders, dimension.ddl())
    return rows.where("NOT _gone").select(*dimension.keys, *dimension.attributes)
