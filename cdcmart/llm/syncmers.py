"""Document fingerprints by closed syncmers.

Of a text's runs of ``K`` words those are anchors whose least inner run of ``S`` words
(by hash) is its first or its last. Whether a run is an anchor hangs on its own words
alone, so equal passages have equal anchors wherever they stand, and two neighbours
among ``K - S + 1`` runs are anchors on average. A fingerprint lists all anchors in
text order, eight hex digits each; texts without any (of fewer than ``K`` words, and
some a little longer) are their own runs of ``S`` words. Words of more than ``LONG`` code
points, as in scripts without spaces, count as their single code points. Likeness is twice the shared anchors over the sum of both (Dice).

DataFrame functions only. The next document in descending doc_id comes by a window over
buckets of some ``BUCKET`` documents, each with the first document of the next bucket added.

Defined cases: null text is empty; texts without words have an empty fingerprint and are
alike among themselves (1), unlike all others (0); rows without doc_id come last, rows with
the same doc_id in the order of a hash of their text; a table of one row is its own next;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cdcmart.llm.common import SPACE_CLASS, checkpointed, maybe_in

K = 6
S = 2
LONG = 32
BUCKET = 2000


def word_numbers(text: Column) -> Column:
    """A hash for each word in order."""
    return F.transform(F.array_remove(F.split(text, f"{SPACE_CLASS}+"), ""), lambda w: F.xxhash64(w))


def units(text: Column) -> Column:
    """A hash for each word in order, and for each code point of words above ``LONG``."""
    words = F.array_remove(F.split(text, f"{SPACE_CLASS}+"), "")
    cut = F.flatten(F.transform(words, lambda w: F.when(F.char_length(w) > LONG, F.array_remove(F.split(w, ""), "")).otherwise(F.array(w))))
    # told by a pattern, so that ordinary texts are not gone through word by word once more
    return F.when(text.rlike(rf"(?:^|{SPACE_CLASS})[^\x20\x09-\x0D]{{{LONG + 1}}}"), F.transform(cut, lambda w: F.xxhash64(w))).otherwise(word_numbers(text))


def inner_runs(words: Column) -> Column:
    """A hash for each run of two words (``S``), in order; of a single word for a text of one."""
    runs = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, runs), F.slice(words, S, runs), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(words) >= S, pairs).otherwise(words)


def chosen_places(runs: Column) -> Column:
    """Places of the closed syncmers over inner runs, in text order."""
    width = K - S + 1

    def chosen(i: Column) -> Column:
        least = F.array_min(F.slice(runs, i + 1, width))
        return (least == F.get(runs, i)) | (least == F.get(runs, i + width - 1))

    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(runs) - width, F.lit(0))), chosen)
    return F.when(F.size(runs) >= width, places).otherwise(F.array().cast("array<int>"))


def anchors(runs: Column, places: Column) -> Column:
    """32-bit hashes of the closed syncmers at ``places``, or of the inner runs if there is none."""
    long = F.transform(places, lambda i: F.hash(F.slice(runs, i + 1, K - S + 1)))
    return F.when(F.size(places) > 0, long).otherwise(F.transform(runs, lambda r: F.hash(r)))


def fingerprint(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda a: F.lpad(F.hex(F.when(a < 0, a.cast("long") + (1 << 32)).otherwise(a.cast("long"))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Dice similarity of two sets of anchors, given distinct."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def with_anchors(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the anchors of a column; columns of their own keep words and runs from being computed twice."""
    rows = rows.withColumn("_words", units(F.col(text))).withColumn("_runs", inner_runs(F.col("_words"))).withColumn("_places", chosen_places(F.col("_runs")))
    return rows.withColumn(name, anchors(F.col("_runs"), F.col("_places"))).drop("_words", "_runs", "_places")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and ``next``, the text of the next document in descending doc_id (of the first after the last)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    low, high, many = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high, buckets = low or 0, high or 0, max(1, -(-many // BUCKET))
    # descending: bucket 0 has the largest ids; rows without one follow all others
    width = max(1, -(-(high - low + 1) // buckets))
    bucket = F.coalesce(F.floor((F.lit(high) - F.col("doc_id")) / width), F.lit(buckets + 1)).cast("long")
    placed = docs.withColumn("_bucket", bucket).withColumn("_order", F.xxhash64("text"))
    heads = placed.groupBy("_bucket").agg(F.max("doc_id").alias("_head"))
    order = Window.orderBy("_bucket")
    last = F.max("_bucket").over(Window.partitionBy())
    heads = checkpointed(heads.select("_head", F.col("_bucket").alias("_from"), F.coalesce(F.lag("_bucket").over(order), last).alias("_to")))
    # the first document of each bucket is also the end of the bucket before
    first = maybe_in(placed, heads.where("_head IS NOT NULL"), "doc_id", "_head").join(heads, F.col("doc_id").eqNullSafe(F.col("_head")))
    one = Window.partitionBy("_to").orderBy("_order")
    without = heads.where("_head IS NULL").select("_from", "_to")
    nameless = placed.where("doc_id IS NULL").join(without, F.col("_bucket") == F.col("_from"))
    ends = first.select("doc_id", "text", "_order", "_to").union(nameless.select("doc_id", "text", "_order", "_to"))
    ends = ends.withColumn("_rank", F.row_number().over(one)).where("_rank = 1")
    both = placed.select("doc_id", "text", "_bucket", "_order", F.lit(0).alias("_end")).union(
        ends.select("doc_id", "text", F.col("_to").alias("_bucket"), "_order", F.lit(1).alias("_end"))
    )
    return both


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row."""
    rows = with_anchors(with_next(docs), "text", "_own")
    order = Window.partitionBy("_bucket").orderBy("_end", F.col("doc_id").desc_nulls_last(), "_order")
    following = rows.withColumn("_next", F.lead(F.struct("text", "_own")).over(order)).where("_end = 0")
    chars = F.char_length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), chars - half), F.substring(F.col("_next.text"), F.lit(1), half))
    rows = with_anchors(following.withColumn("_edited", edited).withColumn("_chars", chars), "_edited", "_changed")
    rows = rows.select(
        "doc_id", F.col("_chars").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), "_own", "_changed",
        F.array_distinct("_own").alias("_a"), F.array_distinct("_changed").alias("_b"), F.array_distinct("_next._own").alias("_c"),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("_own")).alias("fingerprint"), fingerprint(F.col("_changed")).alias("edited_fingerprint"),
        likeness(F.col("_a"), F.col("_b")).alias("near_edited"), likeness(F.col("_a"), F.col("_c")).alias("near_next"),
    )
