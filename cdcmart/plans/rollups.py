"""Current-state rollups of the fast-changing tables, and their reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdcmart.fixed_values import DELIVERED, STEP_DONE_STATES
from cdcmart.functions.columns import count_where, millis_between, percentage
from cdcmart.operators.changelog import argmax_merge, argmax_partial, current, latest_by_version

# rollup name -> (source table, key columns, resolved columns)
ROLLUPS = {
    "rollup_protocol_instance_current": (
        "protocol_instances",
        ("protocol_definition_id", "id"),
        ("patient_id", "protocol_canonical", "status", "enrolled_at"),
    ),
    "rollup_step_current": (
        "step_instances",
        ("protocol_instance_id", "id"),
        ("action_id", "state", "completion_status"),
    ),
    "rollup_deviation_current": (
        "deviations",
        ("protocol_instance_id", "id"),
        ("deviation_type",),
    ),
    "rollup_delivery_current": (
        "intelligence_deliveries",
        ("id",),
        ("destination", "action_type", "subject", "status", "attempt_count", "created_at"),
    ),
}


def rollup_partials(name: str, changes: DataFrame) -> DataFrame:
    """Arg-max states of one batch of changes."""
    _, keys, columns = ROLLUPS[name]
    named = changes.withColumnRenamed("_is_deleted", "is_deleted")
    return argmax_partial(named, keys, (*columns, "is_deleted"))


def read_rollup(name: str, states: DataFrame, drop_deleted: bool = True) -> DataFrame:
    """One row per entity from stored states; deleted entities drop out."""
    return argmax_merge(states, ROLLUPS[name][1], drop_deleted)


def rollup(name: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Batch form: straight from the changelog."""
    source, keys, columns = ROLLUPS[name]
    return latest_by_version(tables[source], keys).select(*keys, *columns)


def outcome_distribution(enrolments: DataFrame) -> DataFrame:
    return enrolments.groupBy("protocol_definition_id", "status").agg(F.count(F.lit(1)).alias("enrollments"))


def enrollment_compliance_rate(steps: DataFrame) -> DataFrame:
    done = count_where(F.col("state").isin(*STEP_DONE_STATES))
    total = F.count(F.lit(1))
    return (
        steps.groupBy("protocol_instance_id")
        .agg(total.alias("total_steps"), done.alias("completed_steps"))
        .withColumn("compliance_rate", percentage(F.col("completed_steps"), F.col("total_steps")))
    )


def delivery_success_rate(deliveries: DataFrame) -> DataFrame:
    return (
        deliveries.groupBy("destination")
        .agg(
            F.count(F.lit(1)).alias("total"),
            count_where(F.col("status") == DELIVERED).alias("delivered"),
            F.bround(F.avg("attempt_count"), 2).alias("avg_attempts"),
        )
        .select(
            "destination",
            "total",
            "delivered",
            percentage(F.col("delivered"), F.col("total")).alias("success_rate_pct"),
            "avg_attempts",
        )
    )


def delivery_latency(tables: Mapping[str, DataFrame]) -> DataFrame:
    latency = millis_between(F.col("created_at"), F.col("delivered_at"))
    return (
        current(tables, "intelligence_deliveries")
        .where("delivered_at IS NOT NULL")
        .groupBy("destination")
        .agg(F.bround(F.avg(latency), 0).alias("avg_latency_ms"))
    )
