"""Change rows -> current state, and partial states that merge into it.

Every reduction here either aggregates map-side or limits each map partition to
one row per key before the exchange, so a key with a third of all versions
sends one row per map task, not all of them, to the task that owns the key.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cdcmart.fixed_values import UNAVAILABLE_VALUE
from cdcmart.functions.derive import with_read_aliases

VERSION = "_version"
DELETED = "_is_deleted"
#: When a stored change row arrived, and its place in that batch (Kafka offset or order of reading).
ARRIVAL = "_arrival"


def latest_by_version(
    df: DataFrame,
    keys: Sequence[str] = ("id",),
    version: str = VERSION,
    deleted: str | None = DELETED,
    arrival: str | None = None,
) -> DataFrame:
    """The row with the highest version per key; gone if that row is a delete.

    Equal versions are settled by ``arrival`` (the stored order of arrival unless
    another column is named), the later one wins. ``row_number() = 1`` plans as a
    group limit below the exchange, and unused columns are pruned through it, which
    a struct-valued ``max_by`` would not allow. Current state (``deleted`` given)
    does not carry the order of arrival any more.
    """
    arrival = arrival or (ARRIVAL if ARRIVAL in df.columns else None)
    order = [F.col(version).desc()] + ([F.col(arrival).desc_nulls_last()] if arrival else [])
    newest = Window.partitionBy(*keys).orderBy(*order)
    latest = df.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
    return latest.where(~F.col(deleted)).drop(ARRIVAL) if deleted else latest


def version_order(df: DataFrame, version: str) -> Column:
    """What decides between states of a key: the version, then the order of arrival."""
    at, row = (F.coalesce(F.col(f"{ARRIVAL}.{f}"), F.lit(0)) if ARRIVAL in df.columns else F.lit(0) for f in ("at", "row"))
    return F.struct(F.col(version).alias("version"), at.cast("bigint").alias("at"), row.cast("bigint").alias("row"))


class Resolved(Mapping):
    """Tables by name, of which those in ``resolved`` are current state already, one row per key."""

    def __init__(self, tables: Mapping[str, DataFrame], resolved: Mapping[str, DataFrame]) -> None:
        self.tables, self.resolved = tables, resolved

    def __getitem__(self, name: str) -> DataFrame:
        return self.resolved[name] if name in self.resolved else self.tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter({*self.tables, *self.resolved})

    def __len__(self) -> int:
        return len({*self.tables, *self.resolved})


def current(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    """The current, non-deleted rows of a changelog table; a table of current state is taken as it is."""
    if isinstance(tables, Resolved) and name in tables.resolved:
        return tables[name]
    return latest_by_version(tables[name])


def register_current_views(tables: Mapping[str, DataFrame], suffix: str = "") -> None:
    """Temp views so that plain SQL always reads deduplicated rows."""
    for name, changes in tables.items():
        with_read_aliases(latest_by_version(changes), name).createOrReplaceTempView(name + suffix)


def dedup(df: DataFrame, key: str = "id") -> DataFrame:
    """Append-only log without redelivered rows."""
    return latest_by_version(df, [key], deleted=None)


def argmax_partial(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    version: str = VERSION,
    skip_null: Sequence[str] = (),
) -> DataFrame:
    """One arg-max state per key: ``state`` holds the columns at the highest
    version, ``state_version`` that version and its order of arrival.

    Columns in ``skip_null`` keep their own newest non-NULL value and version.
    """
    together = [c for c in columns if c not in skip_null]
    order = version_order(df, version)
    aggregates = [
        F.max_by(F.struct(*together), order).alias("state"),
        F.max(order).alias("state_version"),
    ]
    for name in skip_null:
        seen = F.when(F.col(name).isNotNull(), F.struct(order.alias("v"), F.col(name).alias("x")))
        aggregates.append(F.max_by(seen, F.when(F.col(name).isNotNull(), order)).alias(f"state_{name}"))
    return df.groupBy(*keys).agg(*aggregates)


def argmax_merge(partials: DataFrame, keys: Sequence[str], drop_deleted: bool = True) -> DataFrame:
    """Resolve partial arg-max states to one flat row per key.

    Arg-max is associative, so partials of any batching give the same row.
    """
    apart = [c for c in partials.columns if c.startswith("state_") and c != "state_version"]
    merged = partials.groupBy(*keys).agg(
        F.max_by("state", "state_version").alias("state"),
        *[F.max_by(c, F.col(f"{c}.v")).alias(c) for c in apart],
    )
    flat = merged.select(*keys, "state.*", *[F.col(f"{c}.x").alias(c.removeprefix("state_")) for c in apart])
    if drop_deleted and "is_deleted" in flat.columns:
        flat = flat.where(~F.col("is_deleted"))
    return flat


def argmax_combine(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fewer arg-max states of the same meaning, one per key."""
    apart = [c for c in partials.columns if c.startswith("state_") and c != "state_version"]
    merged = partials.groupBy(*keys).agg(
        F.max_by("state", "state_version").alias("state"),
        F.max("state_version").alias("state_version"),
        *[F.max_by(c, F.col(f"{c}.v")).alias(c) for c in apart],
    )
    return merged.select(*partials.columns)


def state_combine(
    partials: DataFrame,
    dims: Sequence[str],
    counts: Sequence[str] = (),
    sketches: Sequence[str] = (),
    anys: Sequence[str] = (),
) -> DataFrame:
    """Fewer count states, distinct sketches and any-value states of the same meaning."""
    merged = partials.groupBy(*dims).agg(
        *[F.sum(c).alias(c) for c in counts],
        *[F.hll_union_agg(c).alias(c) for c in sketches],
        *[F.min(c).alias(c) for c in anys],
    )
    return merged.select(*partials.columns)


def sum_merge(partials: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Re-sum additive partial counts."""
    return partials.groupBy(*dims).agg(*[F.sum(m).alias(m) for m in measures])


def state_merge(
    partials: DataFrame,
    dims: Sequence[str],
    counts: Sequence[str] = (),
    sketches: Sequence[str] = (),
    anys: Sequence[str] = (),
) -> DataFrame:
    """Merge count states, distinct sketches and any-value states."""
    return partials.groupBy(*dims).agg(
        *[F.sum(c).alias(c) for c in counts],
        *[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in sketches],
        *[F.min(c).alias(c) for c in anys],
    )


def running_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, values: Mapping[str, Column]
) -> DataFrame:
    """Newest non-NULL value so far per key, in ``order``, for every row.

    ``slice_by`` must not decrease along ``order``; it cuts a long key into
    slices that run as separate groups, and one summary row per (key, slice)
    carries the value over the cuts. No task holds more of a hot key than a slice,
    so choose slices that bound it. Keys must not be NULL.
    """
    sliced = df.withColumns({"_slice": slice_by, **{f"_in_{n}": e for n, e in values.items()}})
    here = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    within = sliced.withColumns({f"_here_{n}": F.last(f"_in_{n}", ignorenulls=True).over(here) for n in values})

    position = F.struct(*order)
    ends = sliced.groupBy(*keys, "_slice").agg(
        *[
            # max_by passes over rows whose ordering is NULL.
            F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), position)).alias(f"_end_{n}")
            for n in values
        ]
    )
    before = (
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = ends.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_k_slice"),
        *[F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_carry_{n}") for n in values],
    )
    # Plain equality keeps the partitioning of the window; a NULL-safe one would
    # shuffle the whole table again. Keys are required identifiers.
    same = F.col("_slice") == F.col("_k_slice")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    joined = within.join(carried, same, "left")
    return joined.select(
        *[c for c in df.columns if c not in values],
        *[F.coalesce(F.col(f"_here_{n}"), F.col(f"_carry_{n}")).alias(n) for n in values],
    )


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, values: Mapping[str, Column]
) -> DataFrame:
    """Running sums per key in ``order``, cut into slices like :func:`running_last`."""
    sliced = df.withColumns({"_slice": slice_by, **{f"_in_{n}": e for n, e in values.items()}})
    here = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    within = sliced.withColumns({f"_here_{n}": F.sum(f"_in_{n}").over(here) for n in values})
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sliced.groupBy(*keys, "_slice")
        .agg(*[F.sum(f"_in_{n}").alias(f"_end_{n}") for n in values])
        .select(
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            F.col("_slice").alias("_k_slice"),
            *[F.coalesce(F.sum(f"_end_{n}").over(before), F.lit(0)).alias(f"_carry_{n}") for n in values],
        )
    )
    # Plain equality keeps the partitioning of the window; a NULL-safe one would
    # shuffle the whole table again. Keys are required identifiers.
    same = F.col("_slice") == F.col("_k_slice")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    return within.join(carried, same, "left").select(
        *[c for c in df.columns if c not in values],
        *[(F.col(f"_here_{n}") + F.col(f"_carry_{n}")).alias(n) for n in values],
    )


def carry_forward_unavailable(
    df: DataFrame,
    columns: Sequence[str],
    slice_by: Column,
    keys: Sequence[str] = ("id",),
    version: str = VERSION,
    marker: str = UNAVAILABLE_VALUE,
) -> DataFrame:
    """Replace the unavailable-value marker by the key's last known value, or
    NULL where none is known yet."""
    known = {c: F.nullif(F.col(c), F.lit(marker)) for c in columns}
    return running_last(df, keys, [version], slice_by, known)
