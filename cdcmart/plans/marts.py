"""The twelve aggregates kept at insert time.

``mode='changes'`` counts change rows, as an insert-triggered aggregate does: an
update or delete row that passes the filter counts again. ``mode='current'``
counts each entity once, in its current state. For streams, :func:`partials`
gives mergeable states per micro-batch and :func:`merge` resolves them.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cdcmart.fixed_values import INBOUND_ACCEPTED, INBOUND_RECEIVED
from cdcmart.functions.columns import to_millis
from cdcmart.operators.changelog import current, latest_by_version, state_merge


@dataclass(frozen=True)
class Mart:
    source: str
    bucket: tuple[str, str, str]  # unit, time column, output name
    dims: tuple[str, ...]
    counts: tuple[str, ...]
    distinct: tuple[tuple[str, str], ...] = ()  # output name, column
    anys: tuple[tuple[str, str], ...] = ()
    where: str | None = None

    @property
    def keys(self) -> tuple[str, ...]:
        return (self.bucket[2], *self.dims)


MARTS: dict[str, Mart] = {
    "mv_event_volume_hourly": Mart(
        "inbound_event_logs",
        ("HOUR", "event_time", "hour"),
        ("facility_id", "source", "event_type", "resource_type"),
        ("event_count",),
        where=f"status = '{INBOUND_ACCEPTED}' AND event_time IS NOT NULL",
    ),
    "mv_deviation_trends": Mart(
        "deviations", ("DAY", "detected_at", "day"), ("deviation_type",), ("deviation_count",)
    ),
    "mv_deviation_by_protocol": Mart(
        "deviations",
        ("DAY", "detected_at", "day"),
        ("protocol_instance_id", "deviation_type"),
        ("deviation_count",),
    ),
    "mv_ingestion_quality": Mart(
        "inbound_event_logs",
        ("DAY", "received_at", "day"),
        ("source", "status", "rejection_reason"),
        ("event_count",),
        where=f"status <> '{INBOUND_RECEIVED}'",
    ),
    "mv_intelligence_summary": Mart(
        "intelligence_event_logs",
        ("DAY", "created_at", "day"),
        ("action_type", "intelligence_destination", "step_state", "trigger_reason"),
        ("trigger_count",),
        (("unique_patients", "subject"),),
    ),
    "mv_practitioner_summary": Mart(
        "inbound_event_logs",
        ("DAY", "received_at", "day"),
        ("facility_id", "practitioner_ref"),
        ("event_count",),
        (("unique_patients", "subject"), ("resource_type_count", "resource_type")),
        (("practitioner_display", "practitioner_display"),),
        where=f"practitioner_ref <> '' AND status = '{INBOUND_ACCEPTED}'",
    ),
    "mv_facility_summary": Mart(
        "inbound_event_logs",
        ("DAY", "received_at", "day"),
        ("facility_id", "resource_type"),
        ("event_count",),
        (("unique_patients", "subject"), ("unique_practitioners", "practitioner_ref")),
        where=f"facility_id <> '' AND status = '{INBOUND_ACCEPTED}'",
    ),
    "mv_intelligence_by_patient": Mart(
        "intelligence_event_logs",
        ("DAY", "created_at", "day"),
        ("subject", "action_type", "intelligence_destination", "trigger_reason"),
        ("trigger_count",),
    ),
    "mv_intelligence_by_protocol": Mart(
        "intelligence_event_logs",
        ("DAY", "created_at", "day"),
        ("protocol_instance_id", "action_type", "intelligence_destination", "trigger_reason"),
        ("trigger_count",),
        (("unique_patients", "subject"),),
    ),
    "mv_compliance_processing_quality": Mart(
        "compliance_event_logs",
        ("DAY", "received_at", "day"),
        ("source", "processing_status"),
        ("event_count",),
    ),
}


def _bucketed(rows: DataFrame, mart: Mart) -> DataFrame:
    unit, time_column, name = mart.bucket
    kept = rows.where(mart.where) if mart.where else rows
    return kept.withColumn(name, F.date_trunc(unit, F.col(time_column)))


def aggregate(rows: DataFrame, mart: Mart) -> DataFrame:
    """Exact one-shot aggregate."""
    measures: list[Column] = [F.count(F.lit(1)).alias(c) for c in mart.counts]
    measures += [F.count_distinct(c).alias(name) for name, c in mart.distinct]
    measures += [F.min(c).alias(name) for name, c in mart.anys]
    return _bucketed(rows, mart).groupBy(*mart.keys).agg(*measures)


def partials(rows: DataFrame, mart: Mart) -> DataFrame:
    """Mergeable states: counts, HLL sketches, any-value states."""
    measures: list[Column] = [F.count(F.lit(1)).alias(c) for c in mart.counts]
    measures += [F.hll_sketch_agg(c).alias(name) for name, c in mart.distinct]
    measures += [F.min(c).alias(name) for name, c in mart.anys]
    return _bucketed(rows, mart).groupBy(*mart.keys).agg(*measures)


def merge(states: DataFrame, mart: Mart) -> DataFrame:
    return state_merge(
        states, mart.keys, mart.counts, [n for n, _ in mart.distinct], [n for n, _ in mart.anys]
    )


def rows_for(tables: Mapping[str, DataFrame], source: str, mode: str) -> DataFrame:
    if mode not in ("changes", "current"):
        raise ValueError(f"mode must be 'changes' or 'current', not {mode!r}")
    return tables[source] if mode == "changes" else current(tables, source)


def build(name: str, tables: Mapping[str, DataFrame], mode: str = "changes") -> DataFrame:
    """Any of the twelve aggregates by name."""
    if name == "mv_deviation_by_patient":
        return deviation_by_patient(
            rows_for(tables, "deviations", mode), current(tables, "protocol_instances")
        )
    if name == "mv_patient_facility_latest":
        return patient_facility_latest(rows_for(tables, "inbound_event_logs", mode))
    mart = MARTS[name]
    return aggregate(rows_for(tables, mart.source, mode), mart)


def deviation_by_patient(deviations: DataFrame, enrolments: DataFrame) -> DataFrame:
    """Deviations per day, patient and type; unknown enrolment -> patient ''.

    ``enrolments`` is the current state at the time of the call: a batch call
    sees late parents, a micro-batch call does not repair earlier rows.
    Deviations are counted per enrolment before the join, so an enrolment with
    very many deviations crosses it as one row per day and type.
    """
    return _by_patient(deviations, enrolments, sketch=False)


def deviation_by_patient_partials(deviations: DataFrame, enrolments: DataFrame) -> DataFrame:
    """The same with a mergeable distinct state, for one micro-batch."""
    return _by_patient(deviations, enrolments, sketch=True)


def _by_patient(deviations: DataFrame, enrolments: DataFrame, sketch: bool) -> DataFrame:
    per_enrolment = aggregate(deviations, MARTS["mv_deviation_by_protocol"])
    owner = enrolments.select(F.col("id").alias("protocol_instance_id"), "patient_id")
    owned = per_enrolment.join(owner, "protocol_instance_id", "left").withColumn(
        "patient_id", F.coalesce("patient_id", F.lit(""))
    )
    distinct = F.hll_sketch_agg("protocol_instance_id") if sketch else F.count_distinct("protocol_instance_id")
    return owned.groupBy("day", "patient_id", "deviation_type").agg(
        F.sum("deviation_count").alias("deviation_count"), distinct.alias("unique_protocols")
    )


def patient_facility_latest(rows: DataFrame) -> DataFrame:
    """Facility each patient was last seen at; equal moments go to the later version."""
    return patient_facility_states(rows).drop("_version")


def patient_facility_states(rows: DataFrame) -> DataFrame:
    """The same with its tie-breaking version, which a later merge needs."""
    seen = rows.where(
        f"subject <> '' AND facility_id <> '' AND status <> '{INBOUND_RECEIVED}'"
    ).select(
        F.col("subject").alias("patient_id"),
        "facility_id",
        to_millis(F.col("received_at")).alias("last_seen"),
        "_version",
    )
    return newest_facility(seen)


def newest_facility(states: DataFrame) -> DataFrame:
    return latest_by_version(states, ["patient_id"], "last_seen", deleted=None, arrival="_version")


MART_NAMES = (*MARTS, "mv_deviation_by_patient", "mv_patient_facility_latest")
