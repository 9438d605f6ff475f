"""Mixing sources to target weights.

Words are counted per source; the weights share the sum of all words, no source
beyond ``most`` times its own, the excess shared again among the others. From the
targets follow repetition rates: a document is emitted floor(rate) times, and once
more by a draw seeded by a hash of its id whose probability is the fraction of
the rate.

A heavy-tailed source of few documents would miss its target by chance, so the
draw's threshold is moved, within the source, to the hash value at which the words
drawn meet the target (``calibrate=False`` leaves it at the fraction itself). The
threshold is found on a histogram of ``BINS`` hash bins per source, not on rows.

Defined cases: null text has 0 words; a source may be null and comes last; sources
without any word get target 0 and rate 1; repeated rows draw alike; an empty table
gives an empty one; further columns are carried along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cdcmart.llm.common import WORD, checkpointed

WEIGHTS = (5, 2, 1)
MOST = 3
BINS = 1 << 12
#: So many sources at most are broadcast (some 60 bytes each); a longer list is joined by a shuffle.
BROADCAST_SOURCES = 50_000
_DRAWS = 1 << 32


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = "") -> Column:
    """A number below 2**32 that hangs on the id alone."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` for one row (source, source_size) per source.

    The round-by-round resharing ends where every source above a level of
    ``most * size / weight`` has its share of what the sources below, which are
    full, leave over; the sources in that order give the level at once.
    """
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighted = sizes.withColumn("_w", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long"))
    full = F.col("source_size") * most
    order = Window.orderBy(full / F.col("_w"), F.col("source").cast("binary").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(full).over(before), F.lit(0))
    share = weighted.withColumn("_left", left).withColumn("_rest", F.sum("_w").over(rest))
    is_full = full * F.col("_rest") <= F.col("_left") * F.col("_w")
    level = share.withColumn("_open", ~is_full)
    first = F.min(F.when(F.col("_open"), F.struct(full / F.col("_w"), F.col("_left"), F.col("_rest")))).over(Window.partitionBy())
    level = level.withColumn("_level", first)
    target = F.when(is_full, full.cast("double")).otherwise(
        F.col("_level")["_left"] * F.col("_w") / F.col("_level")["_rest"]
    )
    return level.select("source", "source_size", target.cast("double").alias("target"))


def shares(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = "", calibrate: bool = True) -> DataFrame:
    """``docs`` with ``size, source_size, target`` and ``copies``, how often the mix takes each row."""
    size, number = words(F.col("text")), draw(F.col("doc_id"), seed)
    sized = docs.withColumn("size", size).withColumn("_draw", number)
    bins = sized.groupBy("source", F.floor(F.col("_draw") / (_DRAWS // BINS)).alias("_bin")).agg(F.sum("size").alias("_words"))
    sources = targets(bins.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, most)
    sources = sources.withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0))
    sources = sources.withColumn("_whole", F.floor("_rate")).withColumn("_part", F.col("_rate") - F.floor("_rate"))
    if calibrate:
        sources = _calibrated(sources, bins)
    else:
        sources = sources.withColumn("_threshold", F.col("_part") * _DRAWS)
    known = checkpointed(sources.select(F.col("source").alias("_source"), "source_size", "target", "_whole", "_threshold"))
    if known.count() <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    mixed = sized.join(known, F.col("source").eqNullSafe(F.col("_source")), "left")
    copies = F.col("_whole") + F.when(F.col("_draw") < F.col("_threshold"), 1).otherwise(0)
    return mixed.withColumn("copies", copies.cast("long")).drop("_draw", "_source", "_whole", "_threshold")


def _calibrated(sources: DataFrame, bins: DataFrame) -> DataFrame:
    """Threshold within the bin in which the words drawn so far reach the fraction of the source."""
    so_far = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = sources.withColumnRenamed("source", "_name")
    steps = bins.withColumn("_sum", F.sum("_words").over(so_far)).join(named, F.col("source").eqNullSafe(F.col("_name")))
    wanted = F.col("_part") * F.col("source_size")
    width = _DRAWS // BINS
    inside = F.col("_bin") * width + F.when(F.col("_words") > 0, (wanted - (F.col("_sum") - F.col("_words"))) / F.col("_words")).otherwise(0.0) * width
    met = steps.where(F.col("_sum") >= wanted).groupBy("source").agg(F.min(F.struct("_bin", inside.alias("at")))["at"].alias("_threshold"))
    met = met.withColumnRenamed("source", "_name")
    return sources.join(met, F.col("source").eqNullSafe(F.col("_name")), "left").drop("_name").withColumn(
        "_threshold", F.when(F.col("_part") > 0, F.coalesce("_threshold", F.lit(float(_DRAWS)))).otherwise(0.0)
    )


def report(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row."""
    mixed = shares(docs.select("doc_id", "text", "source"), **settings)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    # the row as one value, so that its columns may have any names
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", "source")
    mixed = shares(rows, **settings).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")
