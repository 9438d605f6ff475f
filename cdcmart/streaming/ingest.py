"""Structured Streaming wiring: messages -> changelog, dead letters, aggregates.

Every micro-batch writes folders of its own and enters them in the commit log of the deployment in
one step, under the run of its checkpoint and its number, so at-least-once delivery of a batch still counts
each change once, whichever write it ended after; a new checkpoint starts a new run. No watermark is needed: late rows add
to the bucket of their own time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cdcmart.fixed_values import EPOCH, LOG_RETENTION_DAYS, RETAINED_TABLES
from cdcmart.functions.derive import derive
from cdcmart.operators.changelog import ARRIVAL, argmax_combine, dedup, latest_by_version, state_combine, state_merge
from cdcmart.plans import marts, rollups
from cdcmart.sources.envelope import dead_letters, parse_envelope, typed_changes
from cdcmart.sources.readers import folder_exists, read_changelog
from cdcmart.sources.schemas import TABLES
from cdcmart.streaming import sinks
from cdcmart.streaming.commits import GENERATION, Layout, folders_of, read_folders
from cdcmart.streaming.dimension import Dimension, renew, rows_for

BY_PATIENT = "mv_deviation_by_patient"
PATIENT_FACILITY = "mv_patient_facility_latest"
#: Which patient an enrolment belongs to, for deviations as they come in.
ENROLMENT_PATIENTS = Dimension("enrolment_patients", "protocol_instances", ("id",), ("patient_id",), max_age_seconds=300)


@dataclass(frozen=True)
class Ingest:
    """What one table's stream maintains besides its changelog."""

    table: str
    aggregates: Sequence[str] = field(default_factory=tuple)

    @classmethod
    def everything(cls, table: str) -> Ingest:
        names = [n for n, m in marts.MARTS.items() if m.source == table]
        names += [n for n, (source, _, _) in rollups.ROLLUPS.items() if source == table]
        if table == "deviations":
            names.append(BY_PATIENT)
        if table == "inbound_event_logs":
            names.append(PATIENT_FACILITY)
        return cls(table, tuple(names))


def source_of(name: str) -> str:
    """The table whose changes an aggregate is made of."""
    if name in rollups.ROLLUPS:
        return rollups.ROLLUPS[name][0]
    return {BY_PATIENT: "deviations", PATIENT_FACILITY: "inbound_event_logs"}.get(name) or marts.MARTS[name].source


def batch_states(spark: SparkSession, name: str, changes: DataFrame, layout: Layout) -> DataFrame:
    """Mergeable states of one aggregate for the changes of one micro-batch."""
    if name == BY_PATIENT:
        renew(spark, layout, ENROLMENT_PATIENTS)
        keys = changes.select(F.col("protocol_instance_id").alias("id"))
        return _states(name, changes, rows_for(spark, layout, ENROLMENT_PATIENTS, keys))
    return _states(name, changes)


def _states(name: str, changes: DataFrame, enrolments: DataFrame | None = None) -> DataFrame:
    if name in rollups.ROLLUPS:
        return rollups.rollup_partials(name, changes)
    if name == PATIENT_FACILITY:
        return marts.patient_facility_states(changes)
    if name == BY_PATIENT:
        return marts.deviation_by_patient_partials(changes, enrolments)
    return marts.partials(changes, marts.MARTS[name])


def state_schema(spark: SparkSession, name: str) -> T.StructType:
    """Columns of the stored states of an aggregate, from its plan over empty tables."""
    nothing = {n: spark.createDataFrame([], TABLES[n].stored_ddl()) for n in (source_of(name), "protocol_instances")}
    return _states(name, nothing[source_of(name)], nothing["protocol_instances"].drop(ARRIVAL)).schema


# -- stored tables under the commit log -------------------------------------------


def stored_rows(spark: SparkSession, layout: Layout, table: str, folders: Sequence[str]) -> DataFrame:
    """The change rows in some folders of a changelog."""
    return read_folders(spark, layout.changelog(table), folders, f"{TABLES[table].stored_ddl()}, month int, batch_id string").drop("month", "batch_id")


def load(spark: SparkSession, layout: Layout, table: str, rows: DataFrame) -> str:
    """Store change rows as a load of its own; readers see all of it or nothing."""
    batch = sinks.new_batch("load")
    with sinks.shuffles_cleared(spark):
        sinks.write_changelog(rows, layout.changelog(table), table, batch)
    layout.log(spark).commit({f"changelog/{table}": folders_of(spark, layout.changelog(table), batch)})
    return batch


def store_states(spark: SparkSession, layout: Layout, name: str, states: DataFrame) -> str:
    """Store states of a further batch of an aggregate."""
    batch = sinks.new_batch("states")
    sinks.write_partials(states, layout.partials(name), batch)
    layout.log(spark).commit({f"partials/{name}": folders_of(spark, layout.partials(name), batch)})
    return batch


def read_log(
    spark: SparkSession, layout: Layout, table: str, since: date | None = None, until: date | None = None, as_of: datetime | None = None
) -> DataFrame:
    """The committed changelog of a table; ``since``/``until`` leave out folders of other months.

    Rows whose timestamp was unreadable sit in month 197001 and are always read. With ``as_of`` the rows of a
    table with a retention end where it does, whether or not their folders are gone already.
    """
    spec = TABLES[table]
    retained = as_of is not None and table in RETAINED_TABLES
    if retained:
        since = max(since or date.min, (as_of - timedelta(days=LOG_RETENTION_DAYS)).date())

    def wanted(folder: str) -> bool:
        month = int(folder.split("/")[0].removeprefix("month="))
        low = int(since.strftime("%Y%m")) if since else 0
        high = int(until.strftime("%Y%m")) if until else 999912
        return not spec.month_column or month == 197001 or low <= month <= high

    folders = [f for f in layout.log(spark).folders(f"changelog/{table}") if wanted(f)]
    rows = stored_rows(spark, layout, table, folders)
    return sinks.apply_retention(rows, RETAINED_TABLES[table], as_of) if retained else rows


def read_states(spark: SparkSession, layout: Layout, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Every committed state of an aggregate once; the columns are the declared ones, so none is empty rather than an error."""
    declared = T.StructType([*(schema or state_schema(spark, name)).fields, T.StructField("batch_id", T.StringType())])
    return read_folders(spark, layout.partials(name), layout.log(spark).folders(f"partials/{name}"), declared).drop("batch_id")


def merged(name: str, states: DataFrame) -> DataFrame:
    """The value of an aggregate out of its states."""
    if name in rollups.ROLLUPS:
        return rollups.read_rollup(name, states)
    if name == PATIENT_FACILITY:
        return marts.newest_facility(states).drop("_version")
    if name == BY_PATIENT:
        return state_merge(states, ["day", "patient_id", "deviation_type"], ["deviation_count"], ["unique_protocols"])
    return marts.merge(states, marts.MARTS[name])


def read_aggregate(spark: SparkSession, name: str, layout: Layout) -> DataFrame:
    """The merged value of an aggregate over all batches committed so far."""
    return merged(name, read_states(spark, layout, name))


def combine(name: str, states: DataFrame) -> DataFrame:
    """Fewer states of the same meaning."""
    if name in rollups.ROLLUPS:
        return argmax_combine(states, rollups.ROLLUPS[name][1])
    if name == PATIENT_FACILITY:
        return marts.newest_facility(states)
    if name == BY_PATIENT:
        return state_combine(states, ["day", "patient_id", "deviation_type"], ["deviation_count"], ["unique_protocols"])
    mart = marts.MARTS[name]
    return state_combine(states, mart.keys, mart.counts, [n for n, _ in mart.distinct], [n for n, _ in mart.anys])


def merge_states(
    spark: SparkSession,
    layout: Layout,
    name: str,
    merge: Callable[[DataFrame], DataFrame],
    schema: T.StructType | None = None,
    before_commit: Callable[[], None] | None = None,
) -> list[str]:
    """Put all states committed by now into one batch, in one step; returns the folders replaced.

    Batches that arrive meanwhile stay. A merge that finds its states replaced by another one
    raises ``Conflict`` and leaves no trace in what is read.
    """
    log, table = layout.log(spark), f"partials/{name}"
    folders = log.folders(table)
    if len(folders) < 2:
        return []
    declared = T.StructType([*(schema or state_schema(spark, name)).fields, T.StructField("batch_id", T.StringType())])
    batch = sinks.new_batch("merged")
    sinks.write_partials(merge(read_folders(spark, layout.partials(name), folders, declared).drop("batch_id")), layout.partials(name), batch)
    if before_commit:
        before_commit()
    log.commit({table: folders_of(spark, layout.partials(name), batch)}, {table: folders})
    return folders


def merge_aggregate(spark: SparkSession, name: str, layout: Layout, before_commit: Callable[[], None] | None = None) -> list[str]:
    """:func:`merge_states` of a known aggregate."""
    return merge_states(spark, layout, name, lambda states: combine(name, states), before_commit=before_commit)


def compact(spark: SparkSession, layout: Layout, table: str, month: int, before_commit: Callable[[], None] | None = None) -> list[str]:
    """Put the batches that a month has by now into one set of files, in one step; returns the folders replaced.

    Only superseded versions go. The newest version of a key stays even if it is a delete, because
    an older version may sit in another month. Until the commit readers count the old folders, from
    then on the new one; a batch that arrives meanwhile stays; a second compaction of the same folders raises ``Conflict``.
    """
    log, name, path = layout.log(spark), f"changelog/{table}", layout.changelog(table)
    folders = [f for f in log.folders(name) if f.startswith(f"month={month}/")]
    if len(folders) < 2:
        return []
    rows = stored_rows(spark, layout, table, folders)
    batch = sinks.new_batch("merged")
    sinks.write_changelog(latest_by_version(rows, TABLES[table].keys, deleted=None), path, table, batch)
    if before_commit:
        before_commit()
    log.commit({name: folders_of(spark, path, batch)}, {name: folders})
    return folders


def expire(spark: SparkSession, layout: Layout, table: str, as_of: date, days: int = LOG_RETENTION_DAYS) -> list[str]:
    """Leave out the months that lie wholly before the retention bound of a log table; returns their folders."""
    if table not in RETAINED_TABLES:
        return []
    keep_from = int((as_of - timedelta(days=days)).strftime("%Y%m"))
    log, name = layout.log(spark), f"changelog/{table}"
    gone = [f for f in log.folders(name) if 197001 < int(f.split("/")[0].removeprefix("month=")) < keep_from]
    if gone:
        log.commit({}, {name: gone})
    return gone


def vacuum(spark: SparkSession, layout: Layout, keep_seconds: int = 86_400) -> list[str]:
    """Delete folders that no reader of the last ``keep_seconds`` can have started on: what merges and rebuilds have
    replaced before, and what jobs that ended before their commit left behind."""
    log, gone = layout.log(spark), []
    live, before = log.state().live, log.state_at(keep_seconds).live
    for table in live:
        for folder in log.unused(f"{layout.root}/{table}", set(live[table]), set(before.get(table, [])), keep_seconds):
            sinks.delete(spark, f"{layout.root}/{table}/{folder}")
            gone.append(f"{table}/{folder}")
    return gone


def rebuild(spark: SparkSession, layout: Layout, snapshot: Mapping[str, DataFrame], before_commit: Callable[[], None] | None = None) -> list[str]:
    """Start over from a fresh snapshot: changelogs and the states of all their aggregates, switched in one commit.

    Nothing of what was live when the rebuild began counts afterwards. Batches that streams commit meanwhile stay, and
    their checkpoints go on, so readers and running streams follow without being told. Returns the tables replaced.
    """
    log = layout.log(spark)
    before = log.state().live
    batch, outputs = sinks.new_batch("rebuild"), []
    for table, rows in snapshot.items():
        sinks.write_changelog(rows, layout.changelog(table), table, batch)
        outputs.append(f"changelog/{table}")
        stored = stored_rows(spark, layout, table, folders_of(spark, layout.changelog(table), batch))
        for name in Ingest.everything(table).aggregates:
            enrolments = snapshot.get("protocol_instances")
            enrolments = read_log(spark, layout, "protocol_instances") if enrolments is None else enrolments
            states = _states(name, stored, latest_by_version(enrolments) if name == BY_PATIENT else None)
            sinks.write_partials(states, layout.partials(name), batch)
            outputs.append(f"partials/{name}")
    if before_commit:
        before_commit()
    added = {t: folders_of(spark, f"{layout.root}/{t}", batch) for t in outputs}
    log.commit(added, {t: before.get(t, []) for t in outputs}, notes={GENERATION: batch})
    return outputs


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives in the checkpoint folder: batch numbers are unique within it."""
    path = f"{checkpoint}/cdcmart_run"
    if not folder_exists(spark, path):
        spark.range(1).select(F.lit(uuid.uuid4().hex[:12]).alias("run")).coalesce(1).write.text(path)
    return spark.read.text(path).first()[0]


def process_batch(batch: DataFrame, batch_id: int, ingest: Ingest, layout: Layout, run: str = "run") -> None:
    """Everything one micro-batch of messages leads to: written first, then committed in one step.

    Each attempt writes under a name of its own, so what an attempt that failed has left is never mixed in.
    """
    spark = batch.sparkSession
    log = layout.log(spark)
    if log.done(run, batch_id):
        return
    attempt = f"{run}-{batch_id}-{uuid.uuid4().hex[:8]}"
    parsed = parse_envelope(batch.withColumn(ARRIVAL, sinks.arrival_of(batch)), ingest.table)
    # Nothing is kept in memory: the changelog is written from the messages, the aggregates from the columns they
    # need of it. A batch without a bad message, which the first write tells, is not parsed a second time.
    bad = Observation()
    read = parsed.select("_op", "_row", "_lsn", "_problem", ARRIVAL).observe(bad, F.count("_problem").alias("messages"))
    path = layout.changelog(ingest.table)
    with sinks.shuffles_cleared(spark):
        sinks.write_changelog(derive(typed_changes(read, ingest.table, keep=(ARRIVAL,)), ingest.table), path, ingest.table, attempt)
        if sinks.observed(bad, "messages") != 0:
            sinks.write_partials(dead_letters(parsed).drop(ARRIVAL), layout.dead(ingest.table), attempt)
        changes = stored_rows(spark, layout, ingest.table, folders_of(spark, path, attempt))
        for name in ingest.aggregates:
            sinks.write_partials(batch_states(spark, name, changes, layout), layout.partials(name), attempt)
    outputs = [f"dead_letters/{ingest.table}", f"changelog/{ingest.table}", *(f"partials/{n}" for n in ingest.aggregates)]
    log.commit({t: folders_of(spark, f"{layout.root}/{t}", attempt) for t in outputs}, run=run, batch=batch_id)


def start_ingest(
    messages: DataFrame, ingest: Ingest, layout: Layout, trigger: dict | None = None
) -> StreamingQuery:
    """One streaming query per table, with its own checkpoint."""
    run = run_of(messages.sparkSession, layout.checkpoint(ingest.table))
    return (
        messages.writeStream.queryName(f"ingest_{ingest.table}_{abs(hash(layout.root))}")
        .option("checkpointLocation", layout.checkpoint(ingest.table))
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .foreachBatch(lambda df, batch_id: process_batch(df, batch_id, ingest, layout, run))
        .start()
    )


def append_unseen(
    rows: DataFrame, batch: str, path: str, table: str, event_time: str, look_back: timedelta, key: str = "id"
) -> None:
    """Store the rows of a batch whose key the look-back does not hold yet.

    Compared are the months from the batch's earliest event time less ``look_back``
    on, and the month of unreadable times. A late or unreadable row is late for
    nothing: it is stored like any other.
    """
    spark = rows.sparkSession
    fresh = dedup(rows, key)
    readable = F.when(F.col(event_time) > F.lit(EPOCH).cast("timestamp"), F.col(event_time))
    earliest = fresh.agg(F.min(readable)).first()[0]
    since = (earliest - look_back).date() if earliest else None
    stored = read_changelog(spark, path, table, since=since).select(key)
    sinks.write_changelog(fresh.join(stored, key, "left_anti"), path, table, batch)


def start_dedup(
    changes: DataFrame,
    table: str,
    event_time: str,
    look_back: timedelta,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """An append-only log without redelivered rows, as a stored changelog."""
    run = run_of(changes.sparkSession, checkpoint)
    return (
        changes.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .foreachBatch(lambda df, n: append_unseen(df, f"{run}-{n}", path, table, event_time, look_back))
        .start()
    )


def refresh_once(
    compute: Callable[[datetime], DataFrame], path: str, append: bool, as_of: datetime | None = None
) -> None:
    """Recompute a KPI table: append a snapshot, or replace the table."""
    moment = as_of or datetime.now(timezone.utc).replace(tzinfo=None)
    result = compute(moment)
    if append:
        sinks.append_snapshot(result, path)
    else:
        sinks.replace_table(result, path)


def start_refresh(
    spark: SparkSession,
    compute: Callable[[datetime], DataFrame],
    path: str,
    append: bool,
    checkpoint: str,
    every: str = "30 seconds",
) -> StreamingQuery:
    """Recompute a KPI table on a fixed schedule; runs never overlap."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        ticks.writeStream.option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .foreachBatch(lambda _, __: refresh_once(compute, path, append))
        .start()
    )


def count_by_bucket(changes: DataFrame, column: str, length: str) -> DataFrame:
    """Row counts per tumbling bucket, as a stateful streaming aggregate."""
    return (
        changes.groupBy(F.window(column, length).alias("_w"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(F.col("_w.start").alias("bucket"), "rows")
    )
