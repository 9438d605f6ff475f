"""Read queries of the dashboards, over KPI tables, rollups and the inbound log.

Sorted reports return their rows in order; ties end in the key column.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cdcmart.functions.columns import as_timestamp, percentage, ratio, seconds_between
from cdcmart.operators.changelog import current
from cdcmart.operators.quantiles import merge_quantiles, quantile_states, quantiles_of_counts, read_quantiles, value_counts
from cdcmart.plans.kpis import COMPLIANCE_COLUMNS

Tables = Mapping[str, DataFrame]


def _day(value: date | str):
    return F.lit(str(value)).cast("date")


def dash_compliance_cards(kpis: DataFrame, day: date | str) -> DataFrame:
    """Sums over all protocols of a day and the rate of the sums."""
    return (
        kpis.where(F.col("snapshot_date") == _day(day))
        .agg(
            F.sum("tracked_patients").alias("tracked_patients"),
            F.sum("compliant_count").alias("compliant_count"),
            F.sum("non_compliant_count").alias("non_compliant_count"),
        )
        .withColumn(
            "compliance_rate_pct",
            F.bround(ratio(F.col("compliant_count"), F.col("tracked_patients")) * 100, 1),
        )
    )


def _facility_names(tables: Tables) -> DataFrame:
    """One name per facility, so that the join repeats no row."""
    return current(tables, "facility").groupBy("facility_id").agg(F.min("facility_name").alias("facility_name"))


def _named_adoption(adoption: DataFrame, tables: Tables) -> DataFrame:
    return adoption.join(_facility_names(tables), "facility_id", "left").withColumn(
        "facility_name", F.coalesce("facility_name", F.lit(""))
    )


_ADOPTION = (
    "facility_id",
    "facility_name",
    "expected_patients_per_day",
    "actual_patients",
    "adoption_rate_pct",
    "reporting_gap",
)


def dash_adoption_overview(adoption: DataFrame, tables: Tables, day: date | str) -> DataFrame:
    """A day's adoption, worst under-reporting first."""
    named = _named_adoption(adoption.where(F.col("snapshot_date") == _day(day)), tables)
    return named.select(*_ADOPTION).orderBy(F.desc("reporting_gap"), "facility_id")


def adoption_table(adoption: DataFrame, tables: Tables, day: date | str) -> DataFrame:
    """A day's adoption, best rate first."""
    named = _named_adoption(adoption.where(F.col("snapshot_date") == _day(day)), tables)
    return named.select(*_ADOPTION).orderBy(F.desc("adoption_rate_pct"), "facility_id")


def trend_adoption(adoption: DataFrame, tables: Tables, first: date | str, last: date | str) -> DataFrame:
    within = adoption.where(F.col("snapshot_date").between(_day(first), _day(last)))
    return (
        _named_adoption(within, tables)
        .select(
            "snapshot_date",
            "facility_id",
            "facility_name",
            "actual_patients",
            "expected_patients_per_day",
            "adoption_rate_pct",
        )
        .orderBy("snapshot_date", "facility_id")
    )


def rank_facilities(adoption: DataFrame) -> DataFrame:
    """Rank of each facility by adoption rate within its day."""
    by_rate = Window.partitionBy("snapshot_date").orderBy(F.desc("adoption_rate_pct"))
    return adoption.select(
        "snapshot_date", "facility_id", "adoption_rate_pct", F.rank().over(by_rate).alias("rank_ordinal")
    )


def dash_referrals_by_facility(referrals: DataFrame, first: date | str, last: date | str) -> DataFrame:
    within = referrals.where(F.col("snapshot_date").between(_day(first), _day(last)))
    return (
        within.groupBy("facility_id")
        .agg(F.sum("referral_count").alias("referrals"))
        .orderBy(F.desc("referrals"), "facility_id")
    )


def dash_referrals_total(referrals: DataFrame, first: date | str, last: date | str) -> DataFrame:
    within = referrals.where(F.col("snapshot_date").between(_day(first), _day(last)))
    return within.agg(F.coalesce(F.sum("referral_count"), F.lit(0)).alias("referrals"))


def trend_compliance(kpis: DataFrame, today: date | str, days: int = 30) -> DataFrame:
    recent = kpis.where(F.col("snapshot_date") >= F.date_sub(_day(today), days))
    return (
        recent.groupBy("snapshot_date")
        .agg(
            F.sum("tracked_patients").alias("tracked_patients"),
            F.sum("compliant_count").alias("compliant_count"),
        )
        .withColumn(
            "compliance_rate_pct",
            F.bround(ratio(F.col("compliant_count"), F.col("tracked_patients")) * 100, 1),
        )
        .orderBy("snapshot_date")
    )


def compliance_page(kpis: DataFrame, day: date | str, protocol_definition_id: str) -> DataFrame:
    """All figures of one protocol on one day."""
    wanted = [c for c in COMPLIANCE_COLUMNS if c not in ("snapshot_date", "refreshed_at")]
    return kpis.where(
        (F.col("snapshot_date") == _day(day)) & (F.col("protocol_definition_id") == protocol_definition_id)
    ).select(*wanted)


def deviation_header(deviations: DataFrame, day: date | str | None = None) -> DataFrame:
    """Total and per-type deviation counts of a day, or of all days."""
    if day is not None:
        deviations = deviations.where(F.col("snapshot_date") == _day(day))

    def of_type(kind: str):
        return F.coalesce(
            F.sum(F.when(F.col("deviation_type") == kind, F.col("deviation_count"))), F.lit(0)
        )

    return deviations.agg(
        F.coalesce(F.sum("deviation_count"), F.lit(0)).alias("total_deviations"),
        of_type("OVERDUE").alias("overdue_count"),
        of_type("MISSED").alias("missed_count"),
        of_type("ORDER_VIOLATION").alias("order_violation_count"),
    )


def event_header(events: DataFrame, day: date | str) -> DataFrame:
    """A day's events with matched and zero-match rates."""
    return (
        events.where(F.col("snapshot_date") == _day(day))
        .agg(
            F.sum("total_events").alias("total_events"),
            F.sum("matched_count").alias("_matched"),
            F.sum("zero_match_count").alias("_zero"),
            F.sum("pipeline_loss_count").alias("pipeline_loss_count"),
        )
        .select(
            "total_events",
            percentage(F.col("_matched"), F.col("total_events")).alias("matched_rate_pct"),
            percentage(F.col("_zero"), F.col("total_events")).alias("zero_match_rate_pct"),
            "pipeline_loss_count",
        )
        .limit(1)
    )


def adoption_period_rate(adoption: DataFrame, first: date | str, last: date | str) -> DataFrame:
    """Adoption over several days: actual / (expected x days seen)."""
    within = adoption.where(F.col("snapshot_date").between(_day(first), _day(last)))
    return (
        within.groupBy("facility_id", "expected_patients_per_day")
        .agg(
            F.sum("actual_patients").alias("total_actual"),
            F.count_distinct("snapshot_date").alias("days"),
        )
        .select(
            "facility_id",
            "total_actual",
            (F.col("expected_patients_per_day") * F.col("days")).alias("total_expected"),
        )
        .withColumn("period_rate", percentage(F.col("total_actual"), F.col("total_expected")))
    )


def deviation_unique_patients(occurrences: DataFrame, first: date | str, last: date | str) -> DataFrame:
    """Distinct patients per protocol and type over several days, exact."""
    within = occurrences.where(F.col("snapshot_date").between(_day(first), _day(last)))
    return within.groupBy("protocol_definition_id", "deviation_type").agg(
        F.count_distinct("patient_id").alias("affected_patients")
    )


def merged_unique_patients(deviations: DataFrame, first: date | str, last: date | str) -> DataFrame:
    """The same from the stored daily states, within the sketch's error."""
    within = deviations.where(F.col("snapshot_date").between(_day(first), _day(last)))
    return within.groupBy("protocol_definition_id", "deviation_type").agg(
        F.hll_sketch_estimate(F.hll_union_agg("affected_patients_state")).alias("affected_patients")
    )


def referral_compliance(referrals: DataFrame) -> DataFrame:
    return referrals.select(
        "snapshot_date",
        "facility_id",
        "referral_count",
        "matched_count",
        (F.col("referral_count") - F.col("matched_count")).alias("non_compliant_count"),
        percentage(F.col("matched_count"), F.col("referral_count")).alias("compliance_rate_pct"),
    )


def adoption_fill_zero(adoption: DataFrame, tables: Tables, first: date | str, last: date | str) -> DataFrame:
    """Every facility of the roster on every day, zero where nobody was seen."""
    roster = current(tables, "facility").select("facility_id", "expected_patients_per_day").distinct()
    calendar = roster.withColumn("snapshot_date", F.explode(F.sequence(_day(first), _day(last))))
    seen = adoption.select("snapshot_date", "facility_id", "expected_patients_per_day", "actual_patients")
    filled = calendar.join(
        seen, ["snapshot_date", "facility_id", "expected_patients_per_day"], "left"
    ).withColumn("actual_patients", F.coalesce("actual_patients", F.lit(0)))
    expected, actual = F.col("expected_patients_per_day"), F.col("actual_patients")
    return filled.select(
        "snapshot_date",
        "facility_id",
        "expected_patients_per_day",
        "actual_patients",
        percentage(actual, expected).cast("float").alias("adoption_rate_pct"),
        (expected - actual).alias("reporting_gap"),
    )


def _received_since(tables: Tables, as_of: datetime | str, interval: str) -> DataFrame:
    inbound = current(tables, "inbound_event_logs")
    moment = as_timestamp(as_of)
    return inbound.where(
        (F.col("received_at") >= moment - F.expr(f"INTERVAL {interval}")) & (F.col("received_at") <= moment)
    )


def events_per_minute(tables: Tables, as_of: datetime | str, interval: str = "1 HOUR") -> DataFrame:
    return (
        _received_since(tables, as_of, interval)
        .groupBy(F.date_trunc("MINUTE", "received_at").alias("time"))
        .agg(F.count(F.lit(1)).alias("events"))
        .orderBy("time")
    )


def cdc_freshness_seconds(tables: Tables, as_of: datetime | str) -> DataFrame:
    """Seconds since the newest inbound row."""
    newest = current(tables, "inbound_event_logs").agg(F.max("received_at").alias("_newest"))
    return newest.select(
        seconds_between(F.col("_newest"), as_timestamp(as_of)).alias("seconds_since_last_event")
    )


def _latencies(tables: Tables, as_of: datetime | str, interval: str) -> DataFrame:
    return (
        _received_since(tables, as_of, interval)
        .where("event_time IS NOT NULL")
        .withColumn("_latency", seconds_between(F.col("event_time"), F.col("received_at")))
    )


def e2e_latency_per_minute(tables: Tables, as_of: datetime | str, interval: str = "1 HOUR") -> DataFrame:
    """Median and p95 of received minus occurred, in seconds, per minute."""
    return (
        _latencies(tables, as_of, interval)
        .groupBy(F.date_trunc("MINUTE", "received_at").alias("time"))
        .agg(F.percentile("_latency", F.array(F.lit(0.5), F.lit(0.95))).alias("_p"))
        .select("time", F.col("_p")[0].alias("p50"), F.col("_p")[1].alias("p95"))
        .orderBy("time")
    )


def e2e_latency_p95_5min(tables: Tables, as_of: datetime | str, interval: str = "5 MINUTE") -> DataFrame:
    """The p95 of the look-back, NULL without rows: latencies are counted by value, and only the counts are put in order."""
    counts = value_counts(_latencies(tables, as_of, interval), [], "_latency")
    found = quantiles_of_counts(counts, [], "_latency", {"p95": 0.95})
    return found.agg(F.max("p95").alias("p95"))  # a row even where there is nothing


LATENCY_RANKS = {"p50": 0.5, "p95": 0.95}


def latency_states(rows: DataFrame) -> DataFrame:
    """Stored state of latency for each minute: a quantile sketch of the seconds from event to receipt of the rows given."""
    timed = rows.where("event_time IS NOT NULL").withColumn("_latency", seconds_between(F.col("event_time"), F.col("received_at")))
    return quantile_states(timed.withColumn("time", F.date_trunc("MINUTE", "received_at")), ["time"], "_latency")


def merged_latency(states: DataFrame) -> DataFrame:
    """Median and p95 per minute from the states of any batches."""
    return read_quantiles(merge_quantiles(states, ["time"]), LATENCY_RANKS).orderBy("time")


def merged_latency_p95(states: DataFrame, as_of: datetime | str, interval: str = "5 MINUTE") -> DataFrame:
    """One p95 of the whole minutes of the look-back, merged out of the minutes' states; no row without a state."""
    since = F.date_trunc("MINUTE", as_timestamp(as_of) - F.expr(f"INTERVAL {interval}"))
    within = states.where((F.col("time") > since) & (F.col("time") <= as_timestamp(as_of)))
    return read_quantiles(merge_quantiles(within, []), {"p95": 0.95}).where("n > 0")


def insert_stall(tables: Tables, as_of: datetime | str, interval: str = "10 MINUTE") -> DataFrame:
    """Rows received lately, and whether there were none."""
    return (
        _received_since(tables, as_of, interval)
        .agg(F.count(F.lit(1)).alias("rows_received"))
        .withColumn("stalled", F.col("rows_received") == 0)
    )
