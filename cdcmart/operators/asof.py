"""State as of each day, without joining days to transitions.

A range join of days with all earlier transitions makes days x transitions
pairs. Here transitions are first reduced to one per entity and day, days before
the range folded into its first day. From there a state is valid up to the next
row of its entity, and counts are running sums of day-to-day differences, so
the cost is linear in the transitions plus the rows asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cdcmart.operators.changelog import latest_by_version

DAY = "snapshot_date"


def _date(value: date | str) -> Column:
    return F.lit(str(value)).cast("date")


def folded_day(moment: Column, first: date | str) -> Column:
    return F.greatest(F.to_date(moment), _date(first))


def last_per_day(
    history: DataFrame,
    entity: str,
    first: date | str,
    last: date | str,
    changed_at: str = "changed_at",
    arrival: str = "id",
) -> DataFrame:
    """The last transition per entity and (folded) day, up to ``last``.

    A redelivered transition equals its first copy, so the history needs no
    deduplication before.
    """
    within = history.where(F.to_date(changed_at) <= _date(last))
    return latest_by_version(
        within.withColumn(DAY, folded_day(F.col(changed_at), first)),
        [entity, DAY],
        changed_at,
        deleted=None,
        arrival=arrival,
    )


def asof_states(
    history: DataFrame, entity: str, columns: Sequence[str], first: date | str, last: date | str
) -> DataFrame:
    """One row per (day, entity) with the state at the end of that day.

    An entity appears from the day of its first transition on.
    """
    steps = last_per_day(history, entity, first, last)
    following = F.lead(DAY).over(Window.partitionBy(entity).orderBy(DAY))
    until = F.coalesce(F.date_sub(following, 1), _date(last))
    return steps.withColumn("_until", until).select(
        F.explode(F.sequence(DAY, "_until")).alias(DAY), entity, *columns
    )


def cumulative_by_day(
    deltas: DataFrame, dims: Sequence[str], measures: Sequence[str], last: date | str
) -> DataFrame:
    """Daily differences -> running totals for every day from the first
    difference of each ``dims`` value to ``last``.

    The differences are summed first, so the window holds at most one row per
    day and ``dims`` value whatever the size of the input; days without a
    difference repeat the totals before them.
    """
    summed = deltas.groupBy(*dims, DAY).agg(*[F.sum(m).cast("bigint").alias(m) for m in measures])
    by_day = Window.partitionBy(*dims).orderBy(DAY)
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.coalesce(F.date_sub(F.lead(DAY).over(by_day), 1), _date(last))
    running = summed.select(
        *dims, DAY, until.alias("_until"), *[F.sum(m).over(so_far).alias(m) for m in measures]
    )
    return running.select(*dims, F.explode(F.sequence(DAY, "_until")).alias(DAY), *measures)


def asof_event_counts(
    events: DataFrame,
    entity: str,
    moment: str,
    kinds: dict[str, Column],
    first: date | str,
    last: date | str,
) -> DataFrame:
    """Events of each entity up to each day: one row per (day, entity) from its
    first event on, one count per entry of ``kinds``."""
    per_day = (
        events.where(F.to_date(moment) <= _date(last))
        .withColumn(DAY, folded_day(F.col(moment), first))
        .groupBy(entity, DAY)
        .agg(*[F.count_if(condition).alias(name) for name, condition in kinds.items()])
    )
    by_day = Window.partitionBy(entity).orderBy(DAY)
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.coalesce(F.date_sub(F.lead(DAY).over(by_day), 1), _date(last))
    running = per_day.select(
        entity, DAY, until.alias("_until"), *[F.sum(k).over(so_far).alias(k) for k in kinds]
    )
    return running.select(F.explode(F.sequence(DAY, "_until")).alias(DAY), entity, *kinds)
