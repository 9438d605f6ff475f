"""Exact dedup: two passes of a Bloom filter find the rows that may have an equal; only those are shuffled.

The first pass sets, for each row, one of ``bits`` positions by a hash of its
normalised text and keeps the positions set more than once. They become the
second filter: 64-bit words, broadcast, of which there are at most
``bits / 64`` (2**21 rows of 16 bytes by default, whatever the input). A row whose
bit is not set has no equal and passes straight through. Beyond some hundred
million rows the filter fills up: results stay right, more rows are shuffled;
``bits`` is the parameter for that.

DataFrame functions only. Defined cases: null text is empty text; texts of white
space only are all equal; a null ``doc_id`` counts as larger than any other; rows
with the same text and doc_id are the same document (each is reported as kept
when that document stays, ``deduplicate`` keeps one of them); further columns are
carried along by ``deduplicate`` and ignored by ``report``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cdcmart.llm.common import checkpointed, no_spaces, skew_join

BITS = 1 << 27


def _digest(text: Column) -> Column:
    return F.sha2(no_spaces(text), 256)


def _position(sha: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(bits))


def repeated_positions(digests: DataFrame, bits: int = BITS) -> DataFrame:
    """The second filter: ``_word`` and its 64 ``_bits``, of positions that two rows or more have set."""
    seen = digests.groupBy(_position(F.col("_sha"), bits).alias("_p")).agg(F.count("*").alias("_n")).where("_n > 1")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_p", F.lit(64)).cast("int"))
    return seen.groupBy(F.floor(F.col("_p") / 64).cast("long").alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def _flagged(rows: DataFrame, digests: DataFrame, bits: int) -> DataFrame:
    """``rows`` with ``_maybe``: whether ``digests`` may hold an equal text besides the row's own."""
    placed = rows.withColumn("_p", _position(F.col("_sha"), bits)).withColumn("_word", F.floor(F.col("_p") / 64).cast("long"))
    filtered = placed.join(F.broadcast(checkpointed(repeated_positions(digests, bits))), "_word", "left")
    set_bit = F.getbit(F.coalesce("_bits", F.lit(0).cast("long")), F.pmod("_p", F.lit(64)).cast("int"))
    return filtered.withColumn("_maybe", set_bit == 1).drop("_p", "_word", "_bits")


def report(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Every row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    digests = docs.select(
        "doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("_chars"), _digest(F.col("text")).alias("_sha")
    )
    digests = checkpointed(digests)
    digests = _flagged(digests, digests, bits)
    alone = digests.where(~F.col("_maybe")).withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1).cast("long"))
    maybe = digests.where("_maybe")
    order = F.struct((-F.col("_chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"))
    groups = maybe.groupBy("_sha").agg(F.min(order)["d"].alias("keep_id"), F.count("*").alias("group_size"))
    rows = alone.unionByName(skew_join(maybe, groups, "_sha").select(*alone.columns))
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row of each group of equal texts, with all columns of ``docs``.

    Only rows that the filter flags are shuffled, and of each text at most one row
    per map task: the group limit of ``row_number() = 1`` works below the exchange.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.withColumn("_sha", _digest(F.col("_row.text")))
    digests = checkpointed(rows.select("_sha"))
    flagged = _flagged(rows, digests, bits)
    first = Window.partitionBy("_sha").orderBy(
        F.char_length("_row.text").desc_nulls_last(), F.col("_row.doc_id").asc_nulls_last()
    )
    best = flagged.where("_maybe").withColumn("_rank", F.row_number().over(first)).where("_rank = 1")
    return flagged.where("NOT _maybe").select("_row.*").unionByName(best.select("_row.*"))

