"""Quantiles from states that merge: sketches of stated error, and exact ones from counted values.

A sketch (KLL) holds some kilobytes whatever the number of rows. States of any batches
merge, in any order, and what is read from the merged state lies within ``RANK_ERROR`` of the rank asked for:
of all rows, between ``rank - RANK_ERROR`` and ``rank + RANK_ERROR`` are smaller or equal (with a probability of
about 99 per cent per group; groups of up to ``SIZE`` rows are exact).

Counted values are exact and additive as well. Their running totals are cut into slices of values, so
that no task holds all values of a group, and no aggregate keeps a buffer of values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cdcmart.operators.changelog import running_total

#: Values a level of the sketch keeps, and the error of a rank this gives.
SIZE = 400
RANK_ERROR = 0.01
STATE = "quantile_state"


def quantile_states(rows: DataFrame, dims: Sequence[str], value: str, others: Mapping[str, Column] | None = None) -> DataFrame:
    """A sketch of a whole-number column for each group, with its number of values; NULLs are left out.

    ``others`` are further aggregates of the same rows.
    """
    known = F.col(value).isNotNull()
    sketch = F.kll_sketch_agg_bigint(F.when(known, F.col(value).cast("bigint")), F.lit(SIZE))
    more = [c.alias(n) for n, c in (others or {}).items()]
    return rows.where(known).groupBy(*dims).agg(F.count(F.lit(1)).alias("n"), sketch.alias(STATE), *more)


def merge_quantiles(states: DataFrame, dims: Sequence[str], others: Mapping[str, Column] | None = None) -> DataFrame:
    """Fewer states of the same meaning, one per group; ``dims`` may be coarser than those of the states."""
    more = [c.alias(n) for n, c in (others or {}).items()]
    return states.groupBy(*dims).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint(STATE, F.lit(SIZE)).alias(STATE), *more)


def read_quantiles(states: DataFrame, ranks: Mapping[str, float]) -> DataFrame:
    """The states with the named quantiles instead of the sketch."""
    read = {name: F.kll_sketch_get_quantile_bigint(STATE, F.lit(rank)) for name, rank in ranks.items()}
    return states.withColumns(read).drop(STATE)


def rank_checks(estimates: DataFrame, rows: DataFrame, dims: Sequence[str], value: str, ranks: Mapping[str, float], error: float = RANK_ERROR) -> DataFrame:
    """``dims``, ``n`` and for each quantile whether it lies within ``error`` of its rank (or within one row) among the rows."""
    known = rows.where(F.col(value).isNotNull()).groupBy(*dims, value).agg(F.count(F.lit(1)).alias("_n"))
    named = estimates.select(*[F.col(d).alias(f"_d_{d}") for d in dims], *[F.col(r).alias(f"_q_{r}") for r in ranks])
    same = F.lit(True)
    for d in dims:
        same = same & F.col(d).eqNullSafe(F.col(f"_d_{d}"))
    both = known.join(named, same) if dims else known.join(named)
    counted = [F.sum("_n").alias("n")]
    for r in ranks:
        counted += [F.sum(F.when(F.col(value) < F.col(f"_q_{r}"), F.col("_n")).otherwise(0)).alias(f"_below_{r}")]
        counted += [F.sum(F.when(F.col(value) <= F.col(f"_q_{r}"), F.col("_n")).otherwise(0)).alias(f"_upto_{r}")]
    slack = F.greatest(F.col("n") * error, F.lit(1.0))
    within = {r: (F.col(f"_below_{r}") <= F.col("n") * q + slack) & (F.col(f"_upto_{r}") >= F.col("n") * q - slack) for r, q in ranks.items()}
    return both.groupBy(*dims).agg(*counted).select(*dims, "n", *[c.alias(f"{r}_close") for r, c in within.items()])


def value_counts(rows: DataFrame, dims: Sequence[str], value: str) -> DataFrame:
    """How often each value occurs in a group: an exact state, merged by summing ``n``."""
    return rows.where(F.col(value).isNotNull()).groupBy(*dims, value).agg(F.count(F.lit(1)).alias("n"))


def quantiles_of_counts(counts: DataFrame, dims: Sequence[str], value: str, ranks: Mapping[str, float], slice_width: int = 3600) -> DataFrame:
    """Exact quantiles of counted whole-number values, interpolated between neighbours, one row per group.

    ``slice_width`` is the range of values one task takes of a group. A group is gone if it has no values.
    """
    keys = list(dims) or ["_all"]
    counted = counts if dims else counts.withColumn("_all", F.lit(0))
    upto = running_total(counted, keys, [value], F.floor(F.col(value) / slice_width), {"_upto": F.col("n")}).withColumn("_after", F.col("_upto"))
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("_total")).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_total")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    placed = upto.join(totals, same)
    measures = {}
    for name, rank in ranks.items():
        position = (F.col("_total") - 1) * F.lit(rank)
        for end, at in (("low", F.floor(position)), ("high", F.ceil(position))):
            here = (F.col("_upto") > at) & (F.col("_upto") - F.col("n") <= at)
            measures[f"_{end}_{name}"] = F.max(F.when(here, F.col(value)))
        measures[f"_part_{name}"] = F.max(position - F.floor(position))
    found = placed.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])
    between = [(F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}")).alias(n) for n in ranks]
    return found.select(*dims, *between)
