"""The five daily KPI tables, recomputed in full for a moment ``as_of``.

Event, adoption, referral and deviation figures are keyed on the day something
clinically happened, so a late upload lands on its own day. Each takes the
rolling window in months; the caller's retention must not be shorter.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cdcmart.fixed_values import (
    DEVIATION_TYPES,
    ENCOUNTER,
    ENROLMENT_STATUSES,
    INBOUND_ACCEPTED,
    KPI_WINDOW_MONTHS,
    PROCESSING_OUTCOMES,
    REFERRAL_ACTION_PATTERN,
    STEP_DONE_STATES,
)
from cdcmart.functions.columns import as_timestamp, count_where, months_before, percentage, to_millis
from cdcmart.operators.changelog import current, latest_by_version
from cdcmart.plans.marts import patient_facility_latest

Tables = Mapping[str, DataFrame]

STATUS_COUNTS = {f"status_{s.lower()}": s for s in ENROLMENT_STATUSES}
DEVIATION_COUNTS = {f"{t.lower()}_deviations": t for t in DEVIATION_TYPES}


def step_flags() -> dict[str, Column]:
    """Which step counts a step with ``state``/``completion_status`` adds to."""
    state, outcome = F.col("state"), F.col("completion_status")
    return {
        "step_total": F.lit(True),
        "step_completed": state.isin(*STEP_DONE_STATES),
        "step_overdue": state == "OVERDUE",
        "step_missed": state == "MISSED",
        "step_due": state == "DUE",
        "step_pending": state == "PENDING",
        "step_on_time": outcome == "ON_TIME",
        "step_early": outcome == "EARLY",
        "step_late": outcome == "LATE",
    }


STEP_COUNTS = (
    "step_total",
    "step_completed",
    "step_overdue",
    "step_missed",
    "step_due",
    "step_pending",
    "step_on_time",
    "step_early",
    "step_late",
)

COMPLIANCE_COLUMNS = (
    "snapshot_date",
    "refreshed_at",
    "protocol_definition_id",
    "total_enrollments",
    *STATUS_COUNTS,
    "tracked_patients",
    "compliant_count",
    "non_compliant_count",
    "compliance_rate_pct",
    "total_deviations",
    *DEVIATION_COUNTS,
    *STEP_COUNTS,
)


class WindowExceedsRetention(ValueError):
    """The rolling window reaches back further than rows are kept."""


def check_window(window_months: int, retention_days: int | None) -> None:
    """Refuse a window that silently reads rows retention has removed."""
    if retention_days is not None and window_months * 30 > retention_days:
        raise WindowExceedsRetention(
            f"{window_months} months of history asked for, {retention_days} days kept"
        )


def _stamp(as_of: datetime | str) -> Column:
    return to_millis(as_timestamp(as_of))


def compliance_rate(compliant: Column, tracked: Column) -> Column:
    return percentage(compliant, tracked).cast("float")


def mv_daily_compliance_kpis(tables: Tables, as_of: datetime | str) -> DataFrame:
    """Snapshot per protocol: enrolments, compliance, deviations, steps.

    Deviations and steps are reduced to one row per enrolment first; both joins
    and the enrolments' own deduplication then share one partitioning.
    """
    live = current(tables, "protocol_instances").select(
        F.col("id").alias("protocol_instance_id"), "protocol_definition_id", "status"
    )
    return compliance_of(live, current(tables, "deviations"), current(tables, "step_instances"), as_of)


def compliance_of(live: DataFrame, deviations: DataFrame, steps: DataFrame, as_of: datetime | str) -> DataFrame:
    """The snapshot of current enrolments (``protocol_instance_id``, protocol and status), deviations and steps."""
    counted_deviations = deviations.groupBy("protocol_instance_id").agg(
        F.count(F.lit(1)).alias("total_deviations"),
        *[count_where(F.col("deviation_type") == t).alias(n) for n, t in DEVIATION_COUNTS.items()],
    )
    counted_steps = steps.groupBy("protocol_instance_id").agg(*[count_where(flag).alias(n) for n, flag in step_flags().items()])
    summed = ("total_deviations", *DEVIATION_COUNTS, *STEP_COUNTS)
    per_protocol = (
        live.join(counted_deviations, "protocol_instance_id", "left")
        .join(counted_steps, "protocol_instance_id", "left")
        .groupBy("protocol_definition_id")
        .agg(
            F.count(F.lit(1)).alias("total_enrollments"),
            *[count_where(F.col("status") == s).alias(n) for n, s in STATUS_COUNTS.items()],
            count_where(F.col("total_deviations") > 0).alias("non_compliant_count"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in summed],
        )
    )
    return with_compliance_rate(
        per_protocol.withColumn("snapshot_date", F.to_date(as_timestamp(as_of))), as_of
    )


def with_compliance_rate(per_protocol: DataFrame, as_of: datetime | str) -> DataFrame:
    """Complete and order the columns of a compliance snapshot."""
    completed = per_protocol.withColumns(
        {
            "refreshed_at": _stamp(as_of),
            "tracked_patients": F.col("total_enrollments"),
            "compliant_count": F.col("total_enrollments") - F.col("non_compliant_count"),
        }
    ).withColumn("compliance_rate_pct", compliance_rate(F.col("compliant_count"), F.col("tracked_patients")))
    return completed.select(*COMPLIANCE_COLUMNS)


def step_occurrence() -> Column:
    """When a deviation clinically happened, as far as its step tells; NULL
    leaves the moment it was detected."""
    by_type = (
        F.when(F.col("deviation_type") == "OVERDUE", F.col("overdue_date"))
        .when(F.col("deviation_type") == "MISSED", F.col("missed_date"))
        .when(F.col("deviation_type") == "ORDER_VIOLATION", F.col("completed_at"))
    )
    return F.coalesce(by_type, F.col("due_date"))


def deviation_occurrences(tables: Tables, as_of: datetime | str, window_months: int = KPI_WINDOW_MONTHS) -> DataFrame:
    """Deviations per enrolment, clinical day, step action and type, with the
    enrolment's patient, protocol and facility, and their ``deviation_count``.

    Both joins get counted rows: deviations of one step per day, then of one
    enrolment per day. A step or enrolment with very many deviations crosses
    them as a few rows.
    """
    earliest = months_before(as_of, window_months)
    deviations = (
        current(tables, "deviations")
        .groupBy(
            "step_instance_id",
            "protocol_instance_id",
            "deviation_type",
            F.to_date("detected_at").alias("_detected_day"),
            (F.col("detected_at") >= earliest).alias("_detected_within"),
        )
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    steps = current(tables, "step_instances").select(
        F.col("id").alias("step_instance_id"),
        "action_id",
        "due_date",
        "overdue_date",
        "missed_date",
        "completed_at",
    )
    occurred = F.col("_occurred")
    per_enrolment = (
        deviations.join(steps, "step_instance_id")
        .withColumn("_occurred", step_occurrence())
        .where(F.when(occurred.isNotNull(), occurred >= earliest).otherwise(F.col("_detected_within")))
        .groupBy(
            "protocol_instance_id",
            "action_id",
            "deviation_type",
            F.coalesce(F.to_date(occurred), F.col("_detected_day")).alias("snapshot_date"),
        )
        .agg(F.sum("_n").alias("deviation_count"))
    )
    facility = patient_facility_latest(tables["inbound_event_logs"]).select("patient_id", "facility_id")
    enrolments = (
        current(tables, "protocol_instances")
        .select(
            F.col("id").alias("protocol_instance_id"),
            "patient_id",
            "protocol_definition_id",
            "protocol_canonical",
        )
        .join(facility, "patient_id", "left")
        .withColumn("facility_id", F.coalesce("facility_id", F.lit("")))
    )
    return per_enrolment.join(enrolments, "protocol_instance_id")


DEVIATION_DIMS = (
    "snapshot_date",
    "protocol_definition_id",
    "protocol_canonical",
    "facility_id",
    "action_id",
    "deviation_type",
)


def mv_daily_deviation_kpis(
    tables: Tables,
    as_of: datetime | str,
    window_months: int = KPI_WINDOW_MONTHS,
    states: bool = False,
    retention_days: int | None = None,
) -> DataFrame:
    """Deviations per clinical day; distinct patients exact, or as a mergeable
    HLL state (``states=True``) for stored tables."""
    check_window(window_months, retention_days)
    patients = (
        F.hll_sketch_agg("patient_id").alias("affected_patients_state")
        if states
        else F.count_distinct("patient_id").alias("affected_patients")
    )
    return (
        deviation_occurrences(tables, as_of, window_months)
        .groupBy(*DEVIATION_DIMS)
        .agg(F.sum("deviation_count").alias("deviation_count"), patients)
        .withColumn("refreshed_at", _stamp(as_of))
    )


def accepted_events(tables: Tables, as_of: datetime | str, window_months: int) -> DataFrame:
    """Accepted inbound events of the window, with their clinical day."""
    return (
        current(tables, "inbound_event_logs")
        .where(F.col("status") == INBOUND_ACCEPTED)
        .where(F.col("event_time") >= months_before(as_of, window_months))
        .withColumn("snapshot_date", F.to_date("event_time"))
    )


def latest_outcome(tables: Tables) -> DataFrame:
    """One processing outcome per event; the latest received wins."""
    outcomes = current(tables, "compliance_event_logs").select(
        "cloudevents_id", "processing_status", "received_at", "_version"
    )
    return latest_by_version(
        outcomes, ["cloudevents_id"], "received_at", deleted=None, arrival="_version"
    ).select("cloudevents_id", "processing_status")


def mv_daily_event_kpis(
    tables: Tables,
    as_of: datetime | str,
    window_months: int = KPI_WINDOW_MONTHS,
    retention_days: int | None = None,
) -> DataFrame:
    """Accepted events per clinical day and facility by processing outcome.

    An event without an outcome is pipeline loss; the four counts add up to the
    total.
    """
    check_window(window_months, retention_days)
    events = accepted_events(tables, as_of, window_months).select(
        "cloudevents_id", "snapshot_date", "facility_id"
    )
    outcome = F.col("processing_status")
    return (
        events.join(latest_outcome(tables), "cloudevents_id", "left")
        .groupBy("snapshot_date", "facility_id")
        .agg(
            F.count(F.lit(1)).alias("total_events"),
            count_where(outcome == "MATCHED").alias("matched_count"),
            count_where(outcome == "ZERO_MATCH").alias("zero_match_count"),
            count_where(outcome == "DUPLICATE").alias("duplicate_count"),
            F.count_if(outcome.isNull() | ~outcome.isin(*PROCESSING_OUTCOMES)).alias("pipeline_loss_count"),
        )
        .withColumn("refreshed_at", _stamp(as_of))
    )


def mv_daily_adoption_kpis(
    tables: Tables,
    as_of: datetime | str,
    window_months: int = KPI_WINDOW_MONTHS,
    retention_days: int | None = None,
) -> DataFrame:
    """Distinct patients seen per clinical day against the expected number, for
    facilities of the roster.

    Patients are counted before the roster is joined, so the join handles one
    row per facility and day, and a very busy facility cannot skew it.
    """
    check_window(window_months, retention_days)
    actual = (
        accepted_events(tables, as_of, window_months)
        .where("facility_id <> '' AND subject <> ''")
        .groupBy("snapshot_date", "facility_id")
        .agg(F.count_distinct("subject").alias("actual_patients"))
    )
    roster = current(tables, "facility").select("facility_id", "expected_patients_per_day").distinct()
    expected, seen = F.col("expected_patients_per_day"), F.col("actual_patients")
    return actual.join(roster, "facility_id").select(
        "snapshot_date",
        _stamp(as_of).alias("refreshed_at"),
        "facility_id",
        "expected_patients_per_day",
        "actual_patients",
        percentage(seen, expected).cast("float").alias("adoption_rate_pct"),
        (expected - seen).alias("reporting_gap"),
    )


def referral_completions(tables: Tables) -> DataFrame:
    """Event ids that completed a referral step, each once."""
    steps = (
        current(tables, "step_instances")
        .where(F.col("action_id").rlike(REFERRAL_ACTION_PATTERN))
        .where("completed_by_event_id IS NOT NULL")
        .select(F.col("completed_by_event_id").alias("id"))
        .distinct()
    )
    logs = current(tables, "compliance_event_logs").select("id", "cloudevents_id")
    return logs.join(steps, "id").select("cloudevents_id").distinct()


def mv_daily_referral_kpis(
    tables: Tables,
    as_of: datetime | str,
    window_months: int = KPI_WINDOW_MONTHS,
    retention_days: int | None = None,
) -> DataFrame:
    """Referrals per clinical day and facility: transfer encounters, or events
    that completed a referral step; those that completed one are matched."""
    check_window(window_months, retention_days)
    events = accepted_events(tables, as_of, window_months).select(
        "cloudevents_id",
        "snapshot_date",
        "facility_id",
        ((F.col("resource_type") == ENCOUNTER) & F.col("is_transfer_encounter")).alias("_transfer"),
    )
    completed = referral_completions(tables).withColumn("_matched", F.lit(True))
    flagged = events.join(completed, "cloudevents_id", "left").withColumn(
        "_matched", F.coalesce("_matched", F.lit(False))
    )
    return (
        flagged.where("_transfer OR _matched")
        .groupBy("snapshot_date", "facility_id")
        .agg(
            F.count(F.lit(1)).alias("referral_count"),
            F.count_if("_matched").alias("matched_count"),
        )
        .withColumn("refreshed_at", _stamp(as_of))
    )


KPIS = {
    "mv_daily_compliance_kpis": mv_daily_compliance_kpis,
    "mv_daily_deviation_kpis": mv_daily_deviation_kpis,
    "mv_daily_event_kpis": mv_daily_event_kpis,
    "mv_daily_adoption_kpis": mv_daily_adoption_kpis,
    "mv_daily_referral_kpis": mv_daily_referral_kpis,
}

# Version key of each stored daily table: the newest refresh per key wins.
SNAPSHOT_KEYS = {
    "mv_daily_compliance_kpis": ("snapshot_date", "protocol_definition_id"),
    "mv_daily_deviation_kpis": (
        "snapshot_date",
        "protocol_definition_id",
        "facility_id",
        "action_id",
        "deviation_type",
    ),
    "mv_daily_event_kpis": ("snapshot_date", "facility_id"),
    "mv_daily_adoption_kpis": ("snapshot_date", "facility_id"),
    "mv_daily_referral_kpis": ("snapshot_date", "facility_id"),
}


def snapshot_latest(stored: DataFrame, name: str) -> DataFrame:
    """A stored daily table with only its newest refresh per key."""
    return latest_by_version(stored, SNAPSHOT_KEYS[name], "refreshed_at", deleted=None)
