"""Data-quality report and contract checks."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cdcmart.fixed_values import INBOUND_ACCEPTED
from cdcmart.functions.columns import as_timestamp
from cdcmart.operators.changelog import current
from cdcmart.plans import kpis, marts
from cdcmart.sources.schemas import TABLES

Tables = Mapping[str, DataFrame]

REPORT = "check STRING, value STRING, expected STRING, passed BOOLEAN"


def equals(value: Column, expected: str) -> Column:
    return F.coalesce(value == F.lit(expected), F.lit(False))


def greater_than(value: Column, bound: int) -> Column:
    return F.coalesce(value > bound, F.lit(False))


def is_zero(value: Column) -> Column:
    return F.coalesce(value == 0, F.lit(False))


def _row(name: str, value: Column, expected: str, passed: Column) -> Column:
    return F.struct(
        F.lit(name).alias("check"),
        value.cast("string").alias("value"),
        F.lit(expected).alias("expected"),
        passed.alias("passed"),
    )


def _more_than_zero(name: str, column: str) -> Column:
    return _row(name, F.col(column), "> 0", greater_than(F.col(column), 0))


def _zero(name: str, column: str) -> Column:
    return _row(name, F.col(column), "0", is_zero(F.col(column)))


def _state(name: str, column: str, wanted: str) -> Column:
    return _row(name, F.col(column), wanted, equals(F.col(column), wanted))


def _report(facts: DataFrame, *rows: Column) -> DataFrame:
    return facts.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def orphans(children: DataFrame, parent_key: str, parents: DataFrame) -> DataFrame:
    """Children whose parent is not in the current state."""
    known = parents.select(F.col("id").alias(parent_key))
    return children.join(known, parent_key, "left_anti")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def aggregate_drift(quality: DataFrame, volume: DataFrame, day: Column) -> DataFrame:
    """Two aggregates that should agree on a day's accepted events: 1 when they
    differ by more than one per cent. Both sides are single numbers."""
    accepted = quality.where((F.to_date("day") == day) & (F.col("status") == INBOUND_ACCEPTED)).select(
        F.col("event_count").alias("a"), F.lit(0).cast("bigint").alias("b")
    )
    hourly = volume.where(F.to_date("hour") == day).select(
        F.lit(0).cast("bigint").alias("a"), F.col("event_count").alias("b")
    )
    both = accepted.unionByName(hourly).agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")
    )
    return both.withColumn("drift", _drift("a", "b"))


def _drift(left: str, right: str) -> Column:
    apart = F.abs(F.col(left) - F.col(right)) > F.greatest(F.col(left), F.lit(1)) * 0.01
    return apart.cast("int")


def _today_counts(tables: Tables, today: Column, aggregates: Tables | None) -> DataFrame:
    """One row of today's accepted events: ``a`` by receipt and ``b`` by clinical
    time, from the stored aggregates or else the change rows they are kept over,
    and ``received`` by receipt from the change rows."""
    accepted = tables["inbound_event_logs"].where(F.col("status") == INBOUND_ACCEPTED)
    received = F.count_if(F.to_date("received_at") == today)
    occurred = F.count_if(F.coalesce(F.to_date("event_time") == today, F.lit(False)))
    if aggregates is None:
        return accepted.agg(received.alias("a"), occurred.alias("b"), received.alias("received"))
    nothing = F.lit(0).cast("bigint")
    stored = aggregate_drift(aggregates["mv_ingestion_quality"], aggregates["mv_event_volume_hourly"], today)
    counted = accepted.agg(received.alias("received")).select(nothing.alias("a"), nothing.alias("b"), "received")
    return (
        stored.select("a", "b", nothing.alias("received"))
        .unionByName(counted)
        .agg(*[F.sum(c).alias(c) for c in ("a", "b", "received")])
    )


def _with_orphans(children: DataFrame, parent_key: str, parents: DataFrame) -> DataFrame:
    """One row: the number of children and of those without a parent. Children
    are counted per parent before the join."""
    known = parents.select(F.col("id").alias(parent_key), F.lit(True).alias("_known"))
    per_parent = children.groupBy(parent_key).agg(F.count(F.lit(1)).alias("_n"))
    return per_parent.join(known, parent_key, "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("orphans"),
    )


def run_checks(tables: Tables, as_of: datetime | str, aggregates: Tables | None = None) -> DataFrame:
    """All checks as one report: check, value, expected, passed.

    Facts about one table come out of one pass over it. ``aggregates`` are the
    stored insert-time aggregates to compare with each other.
    """
    moment = as_timestamp(as_of)
    today = F.to_date(moment)
    inbound = current(tables, "inbound_event_logs")
    last_hour = F.col("received_at") >= moment - F.expr("INTERVAL 1 HOUR")

    per_event = inbound.groupBy("cloudevents_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("source") == "").alias("empty_source"),
        F.count_if(F.col("received_at") > moment + F.expr("INTERVAL 1 HOUR")).alias("future"),
        F.count_if(last_hour).alias("recent"),
        F.max("received_at").alias("newest"),
    )
    inbound_facts = per_event.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "empty_source", "future")],
        F.count_if(F.col("recent") > 1).alias("repeated"),
        F.when(F.max("newest") >= moment - F.expr("INTERVAL 10 MINUTES"), "ok").otherwise("stale").alias("fresh"),
    )
    intelligence_facts = current(tables, "intelligence_event_logs").agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.max("created_at") >= moment - F.expr("INTERVAL 1 HOUR"), "ok").otherwise("stale").alias("fresh"),
    )

    def count_of(df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n"))

    steps, enrolments = current(tables, "step_instances"), current(tables, "protocol_instances")
    # A key repeated in the last hour was received then, so older rows do not matter.
    changes_last_hour = repeated(
        tables["inbound_event_logs"].where(last_hour).select("cloudevents_id"), "cloudevents_id"
    )
    counts = _today_counts(tables, today, aggregates)

    parts = [
        _report(
            inbound_facts,
            _more_than_zero("rows present: inbound_event_logs", "n"),
            _zero("inbound_event_logs: source never blank", "empty_source"),
            _zero("inbound_event_logs: received_at at most an hour ahead", "future"),
            _state("newest inbound_event_logs row within 10 minutes", "fresh", "ok"),
            _zero("inbound_event_logs: each event once in the last hour", "repeated"),
        ),
        _report(
            intelligence_facts,
            _more_than_zero("rows present: intelligence_event_logs", "n"),
            _state("newest intelligence_event_logs row within an hour", "fresh", "ok"),
        ),
        _report(
            count_of(current(tables, "protocol_definitions")),
            _more_than_zero("rows present: protocol_definitions", "n"),
        ),
        _report(count_of(enrolments), _more_than_zero("rows present: protocol_instances", "n")),
        _report(
            _with_orphans(steps, "protocol_instance_id", enrolments),
            _more_than_zero("rows present: step_instances", "n"),
            _zero("step_instances: every enrolment known", "orphans"),
        ),
        _report(
            _with_orphans(current(tables, "deviations"), "step_instance_id", steps),
            _zero("deviations: every step known", "orphans"),
        ),
        _report(
            counts.select(_drift("a", "b").alias("drift"), _drift("a", "received").alias("same_clock")),
            _zero("marts agree on today's accepted events", "drift"),
            _zero("quality mart agrees with today's changes by receipt", "same_clock"),
        ),
        _report(
            count_of(changes_last_hour),
            _zero("inbound changes: each event once in the last hour", "n"),
        ),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def contract_problems(tables: Tables) -> list[str]:
    """Everything a deployment must provide, checked on schemas alone."""
    problems = []
    for name, spec in TABLES.items():
        if name not in tables:
            problems.append(f"table {name} is missing")
            continue
        have = set(tables[name].columns)
        wanted = [*spec.columns, *spec.derived, "_version", "_is_deleted"]
        problems += [f"{name}.{c} is missing" for c in wanted if c not in have]
    for name in marts.MART_NAMES:
        if name in marts.MARTS and marts.MARTS[name].source not in tables:
            problems.append(f"{name} has no source")
    if kpis.KPI_WINDOW_MONTHS != 12:
        problems.append("daily KPIs must cover twelve months")
    return problems
