"""The compliance table kept up from stored rollup states, by what has changed.

A refresh asks the commit log which states have arrived since the one before, takes their enrolments and
the protocols these belong or belonged to, and computes those protocols anew from the merged
states; all other protocols keep their figures. No changelog is read. States that a merge has put together with new ones
count as new, which costs work and changes nothing. The new table and the log position it stands
for change in one commit; of two refreshes at once one is refused.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cdcmart.functions.columns import as_timestamp, to_millis
from cdcmart.operators.changelog import argmax_merge
from cdcmart.plans import kpis
from cdcmart.streaming import ingest, sinks
from cdcmart.streaming.commits import GENERATION, Layout, folders_of, read_folders

ENROLMENTS, STEPS, DEVIATIONS = "rollup_protocol_instance_current", "rollup_step_current", "rollup_deviation_current"
ROLLUPS = (ENROLMENTS, STEPS, DEVIATIONS)
TABLE = "kpi/mv_daily_compliance_kpis"
_SEEN = "compliance_seen"


def _enrolments(states: DataFrame) -> DataFrame:
    """Current enrolments; one that has changed its protocol belongs to the newest."""
    named = states.withColumn("state", F.col("state").withField("protocol_definition_id", F.col("protocol_definition_id")))
    merged = argmax_merge(named.drop("protocol_definition_id"), ["id"])
    return merged.select(F.col("id").alias("protocol_instance_id"), "protocol_definition_id", "status")


def compliance_from_states(states: dict[str, DataFrame], as_of: datetime | str) -> DataFrame:
    """The snapshot out of rollup states, each enrolment with all its states."""
    steps = argmax_merge(states[STEPS], ["protocol_instance_id", "id"])
    deviations = argmax_merge(states[DEVIATIONS], ["protocol_instance_id", "id"])
    return kpis.compliance_of(_enrolments(states[ENROLMENTS]), deviations, steps, as_of)


def _schema(spark: SparkSession) -> T.StructType:
    empty = {n: spark.createDataFrame([], ingest.state_schema(spark, n)) for n in ROLLUPS}
    return T.StructType([*compliance_from_states(empty, "2000-01-01").schema.fields, T.StructField("batch_id", T.StringType())])


def _stored(spark: SparkSession, layout: Layout, folders: list[str]) -> DataFrame:
    return read_folders(spark, f"{layout.root}/{TABLE}", folders, _schema(spark)).drop("batch_id")


def read_compliance(spark: SparkSession, layout: Layout) -> DataFrame:
    """The table of the last refresh; empty before the first."""
    return _stored(spark, layout, layout.log(spark).folders(TABLE))


def touched_protocols(spark: SparkSession, layout: Layout, since: int) -> DataFrame:
    """Protocols with an enrolment of which any state has arrived after entry ``since`` of the log."""
    log, ids = layout.log(spark), None
    for name in ROLLUPS:
        declared = T.StructType([*ingest.state_schema(spark, name).fields, T.StructField("batch_id", T.StringType())])
        rows = read_folders(spark, layout.partials(name), log.added_since(since, f"partials/{name}"), declared)
        some = rows.select(F.col("id" if name == ENROLMENTS else "protocol_instance_id").alias("id"))
        ids = some if ids is None else ids.union(some)
    known = ingest.read_states(spark, layout, ENROLMENTS).select("protocol_definition_id", "id")
    return known.join(ids.distinct(), "id", "left_semi").select("protocol_definition_id").distinct()


def recomputed(spark: SparkSession, layout: Layout, protocols: DataFrame, as_of: datetime | str) -> DataFrame:
    """The snapshot of some protocols: all states of their enrolments, and none of others."""
    states = {n: ingest.read_states(spark, layout, n) for n in ROLLUPS}
    members = states[ENROLMENTS].join(protocols, "protocol_definition_id", "left_semi").select("id").distinct()
    states[ENROLMENTS] = states[ENROLMENTS].join(members, "id", "left_semi")
    ids = members.select(F.col("id").alias("protocol_instance_id"))
    for name in (STEPS, DEVIATIONS):
        states[name] = states[name].join(ids, "protocol_instance_id", "left_semi")
    found = compliance_from_states(states, as_of)
    return found.join(protocols, "protocol_definition_id", "left_semi").select(*found.columns)


def refresh_compliance(spark: SparkSession, layout: Layout, as_of: datetime | str) -> int:
    """Bring the table up to now; returns how many protocols were computed anew.

    All rows carry the day and moment of this refresh. A first refresh, and the first after a rebuild, computes every protocol.
    """
    log = layout.log(spark)
    state = log.state()
    seen = state.notes.get(_SEEN)
    position = seen or {"entry": 0, "generation": None}
    generation = state.notes.get(GENERATION)
    before = state.live.get(TABLE, [])
    fresh = position["generation"] != generation
    protocols = touched_protocols(spark, layout, 0 if fresh else position["entry"]).persist()
    try:
        changed = protocols.count()
        kept = _stored(spark, layout, [] if fresh else before).join(protocols, "protocol_definition_id", "left_anti")
        moment = {"snapshot_date": F.to_date(as_timestamp(as_of)), "refreshed_at": to_millis(as_timestamp(as_of))}
        result = recomputed(spark, layout, protocols, as_of)
        batch = sinks.new_batch("refresh")
        sinks.write_partials(result.unionByName(kept.withColumns(moment)), f"{layout.root}/{TABLE}", batch)
    finally:
        protocols.unpersist()
    log.commit(
        {TABLE: folders_of(spark, f"{layout.root}/{TABLE}", batch)},
        {TABLE: before},
        notes={_SEEN: {"entry": state.number, "generation": generation}},
        expected={_SEEN: seen, GENERATION: generation},
    )
    return changed


def start_compliance(spark: SparkSession, layout: Layout, every: str = "30 seconds") -> StreamingQuery:
    """Refresh on a fixed schedule; runs never overlap."""

    def refresh(_batch: DataFrame, _number: int) -> None:
        refresh_compliance(spark, layout, datetime.now(timezone.utc).replace(tzinfo=None))

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.option("checkpointLocation", layout.checkpoint("refresh_compliance")).trigger(processingTime=every).foreachBatch(refresh).start()
