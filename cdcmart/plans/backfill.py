"""Rebuild past daily compliance snapshots from the transition history.

Every count is a running sum of day-to-day differences: an enrolment adds 1 to
its new status and takes 1 from the old one, a deviation or step counts from the
day it and its enrolment both exist. Nothing is joined to the calendar.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cdcmart.operators.asof import DAY, cumulative_by_day, folded_day, last_per_day
from cdcmart.operators.changelog import current
from cdcmart.plans.kpis import (
    DEVIATION_COUNTS,
    STATUS_COUNTS,
    STEP_COUNTS,
    step_flags,
    with_compliance_rate,
)

PROTOCOL = "protocol_definition_id"
MEASURES = (
    "total_enrollments",
    *STATUS_COUNTS,
    "non_compliant_count",
    "total_deviations",
    *DEVIATION_COUNTS,
    *STEP_COUNTS,
)


def backfill_daily_compliance(
    tables: Mapping[str, DataFrame],
    first: date | str,
    last: date | str,
    refreshed_at: datetime | str,
) -> DataFrame:
    """The compliance snapshot of every day from ``first`` to ``last``."""
    known = known_enrolments(tables)
    days = enrolment_days(tables, known, first, last)
    started = enrolment_starts(days)
    deltas = [
        enrolment_deltas(days),
        deviation_deltas(tables, started, first, last),
        step_deltas(tables, started, first, last),
    ]
    combined = None
    for part in deltas:
        padded = part.select(
            PROTOCOL,
            DAY,
            *[(F.col(m) if m in part.columns else F.lit(0)).cast("bigint").alias(m) for m in MEASURES],
        )
        combined = padded if combined is None else combined.unionByName(padded)
    daily = cumulative_by_day(combined, [PROTOCOL], MEASURES, last)
    return with_compliance_rate(daily.where("total_enrollments > 0"), refreshed_at)


def _step(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)).cast("int")


def known_enrolments(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Enrolments that still exist, with their protocol; deleted ones drop out."""
    return current(tables, "protocol_instances").select(F.col("id").alias("protocol_instance_id"), PROTOCOL)


def enrolment_days(tables: Mapping[str, DataFrame], known: DataFrame, first, last) -> DataFrame:
    """Last status per enrolment and day, with the protocol of the enrolment."""
    return (
        last_per_day(tables["protocol_instance_history"], "protocol_instance_id", first, last)
        .select("protocol_instance_id", DAY, "status")
        .join(known, "protocol_instance_id")
    )


def enrolment_starts(days: DataFrame) -> DataFrame:
    """The (folded) day each enrolment appears: its first in :func:`enrolment_days`."""
    return days.groupBy("protocol_instance_id", PROTOCOL).agg(F.min(DAY).alias("_start"))


def enrolment_deltas(days: DataFrame) -> DataFrame:
    before = F.lag("status").over(Window.partitionBy("protocol_instance_id").orderBy(DAY))
    moved = days.withColumn("_before", before)
    return moved.select(
        PROTOCOL,
        DAY,
        F.col("_before").isNull().cast("int").alias("total_enrollments"),
        *[
            (_step(F.col("status") == s) - _step(F.col("_before") == s)).alias(n)
            for n, s in STATUS_COUNTS.items()
        ],
    )


def deviation_deltas(tables: Mapping[str, DataFrame], started: DataFrame, first, last) -> DataFrame:
    per_day = (
        current(tables, "deviations")
        .where(F.to_date("detected_at") <= F.lit(str(last)).cast("date"))
        .withColumn("_day", folded_day(F.col("detected_at"), first))
        .groupBy("protocol_instance_id", "_day")
        .agg(
            F.count(F.lit(1)).alias("total_deviations"),
            *[F.count_if(F.col("deviation_type") == t).alias(n) for n, t in DEVIATION_COUNTS.items()],
        )
    )
    order = F.row_number().over(Window.partitionBy("protocol_instance_id").orderBy("_day"))
    return per_day.join(started, "protocol_instance_id").select(
        PROTOCOL,
        F.greatest("_day", "_start").alias(DAY),
        (order == 1).cast("int").alias("non_compliant_count"),
        "total_deviations",
        *DEVIATION_COUNTS,
    )


def step_deltas(tables: Mapping[str, DataFrame], started: DataFrame, first, last) -> DataFrame:
    states = last_per_day(tables["step_instance_history"], "step_instance_id", first, last).select(
        "step_instance_id", F.col(DAY).alias("_day"), "state", "completion_status"
    )
    owned = (
        current(tables, "step_instances")
        .select(F.col("id").alias("step_instance_id"), "protocol_instance_id")
        .join(started, "protocol_instance_id")
        .select("step_instance_id", PROTOCOL, "_start")
    )
    counted = states.join(owned, "step_instance_id").withColumn(DAY, F.greatest("_day", "_start"))
    # Transitions before the enrolment all fall on its first day; the last one stands.
    by_step = Window.partitionBy("step_instance_id").orderBy("_day")
    following = F.lead(DAY).over(by_step)
    standing = counted.withColumn("_next", following).where(
        F.col("_next").isNull() | (F.col("_next") > F.col(DAY))
    )
    flags = step_flags()
    now = standing.select("step_instance_id", "_day", PROTOCOL, DAY, *[_step(e).alias(n) for n, e in flags.items()])
    return now.select(
        PROTOCOL,
        DAY,
        *[(F.col(n) - F.coalesce(F.lag(n).over(by_step), F.lit(0))).alias(n) for n in STEP_COUNTS],
    )
