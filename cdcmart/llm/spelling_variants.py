"""Groups of spelling variants by a bit-sliced position index.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. A
bundle of up to ``BUNDLE`` words is indexed by one bitset over its words for each (position,
letter). A query word runs over its letters once and carries three bitsets: the words that
agree so far (zero errors), those that agree but for one replaced letter, and those that agree but for one
letter more (one error, read at positions shifted by one). Each step is a few word-parallel AND
and OR over the whole bundle. A deleted letter is the inserted one seen from the other word, so queries are the
words of one length and find those of the same and the next length.

Words meet in groups of those that agree outside a span ``[low, high)`` of a length: at first the
whole word, and a group too large to search at once (``GROUP_PLACES``, words times span) is split
in two: words that agree on the first half of the span as well, and words that agree on
the second half. The first place where two near words differ lies in one of the halves, so
each pair is found in exactly one group. A span of one place holds at most as many words as one
and two letters make, so splitting ends; hot groups never reach a task whole. Pairs stay inside a
task: what leaves it is one row per word of the number of near words and the most frequent one.

Defined cases: null text has no words; a row without doc_id seeds its misspellings with an empty
id; rows with the same doc_id are separate; a table without words gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdcmart.llm.common import checkpointed, skew_join, slices

#: Words have at least this many code points, and occur at least so often.
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A form occurs at least this many times as often as its variant.
RATIO = 2
#: Words times places of the span above which a group is split.
GROUP_PLACES = 1 << 16
#: Words that share an index, unless one group has more, and places (words times span) of an index of several groups.
BUNDLE = 2048
BUNDLE_PLACES = 1 << 17
#: Queries that run over an index at once, times the 64-bit words of a bitset.
QUERY_WORDS = 1 << 14
#: Counts that a task holds before it passes them on.
HELD = 200_000

_RUN = re.compile("[a-zÀ-ÿ]+")
#: One run in so many loses a letter.
_MISSPELT = 97


def words_of(docs: DataFrame) -> DataFrame:
    """``word, n``: occurrences of the words of all texts, after the seeded misspellings; counted before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                ids = batch.column("doc_id").slice(start, stop - start).to_pylist()
                for doc_id, text in zip(ids, batch.column("text").slice(start, stop - start).to_pylist(), strict=True):
                    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    # lower-cased as bytes: letters beyond A to Z stay as they are
                    for run, n in Counter(_RUN.findall((text or "").encode().lower().decode())).items():
                        h = zlib.crc32(run.encode(), seed)
                        if h % _MISSPELT == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                        if len(run) >= LEAST_LENGTH:
                            held[run] += n
                    if len(held) > HELD:
                        yield _counts(held)
                        held = Counter()
        yield _counts(held)

    found = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _counts(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def groups(words: DataFrame, group_places: int = GROUP_PLACES) -> DataFrame:
    """Members of the groups that are searched: each word for its own length and for that of words one shorter.

    ``length`` is that of the shorter words of the group and ``[low, high)`` the span in which words may
    differ (by one place more for the longer). ``_group`` stands for what all have before and after it.
    """
    size, after = F.char_length("word"), F.col("length") - F.col("high")
    outside = F.xxhash64("length", "low", "high", F.substring("word", F.lit(1), F.col("low")), F.substring("word", size - after + 1, after))
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("length")).where(F.col("length") >= LEAST_LENGTH)
    rows = rows.withColumns({"low": F.lit(0), "high": F.col("length")}).withColumn("_group", outside)
    done = None
    while True:
        sizes = rows.groupBy("_group").agg(F.count("*").alias("_many"), F.min(size - F.col("length")).alias("_least"))
        # a group without a word of its length has only words of one more, which meet elsewhere
        sized = checkpointed(skew_join(rows, sizes.where("_many > 1 AND _least = 0").drop("_least"), "_group"))
        large = (F.col("_many") * (F.col("high") - F.col("low")) > group_places) & (F.col("high") - F.col("low") > 1)
        ready = sized.where(~large).drop("_many")
        done = ready if done is None else done.union(ready)
        rest = sized.where(large)
        if rest.isEmpty():
            return done
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct(middle.alias("low"), F.col("high")), F.struct(F.col("low"), middle.alias("high")))
        rows = rest.select("word", "n", "length", F.inline(halves)).withColumn("_group", outside)


def near_pairs(words: list[str], group: np.ndarray, length: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``words`` of all pairs that are near and differ first in the span; the first of a pair has ``length``.

    ``words`` have ``length`` letters or one more, and those of a ``group`` agree outside the span.
    Pairs of words of the same length come in both orders.
    """
    span = high - low
    middles = [w[low : low + span + len(w) - length] for w in words]
    codes = np.zeros((len(words), span + 1), np.int64)
    for i, m in enumerate(middles):
        codes[i, : len(m)] = np.frombuffer(m.encode("utf-32-le"), "<u4")
    letters, coded = np.unique(codes, return_inverse=True)
    coded = coded.reshape(codes.shape)
    longer = np.array([len(w) > length for w in words])
    wide = -(-len(words) // 64)

    def bits(chosen: np.ndarray) -> np.ndarray:
        """Bitsets over the words, from booleans in the last dimension."""
        padded = np.zeros((*chosen.shape[:-1], wide * 64), bool)
        padded[..., : len(words)] = chosen
        return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)

    index = np.stack([bits(coded[:, p] == np.arange(len(letters))[:, None]) for p in range(span + 1)])
    same, more = bits(~longer), bits(longer)
    members = bits(group == np.arange(group.max() + 1)[:, None])
    whole = high == length  # the span reaches to the end
    left, right = [], []
    queries = np.flatnonzero(~longer)
    step = max(1, QUERY_WORDS // wide)
    for some in (queries[i : i + step] for i in range(0, len(queries), step)):
        agree = members[group[some]]
        replaced = np.zeros_like(agree)
        inserted = np.zeros_like(agree)
        for p in range(span):
            here, shifted = index[p][coded[some, p]], index[p + 1][coded[some, p]]
            other = agree & ~here
            replaced = (replaced & here) | other
            inserted = (inserted & shifted) | (other & shifted)
            agree = agree & here
        near = (replaced & same) | (inserted & more)
        if whole:  # one letter more after the last
            near |= agree & more
        row, word = np.nonzero(near)
        found = np.unpackbits(near[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        pair, bit = np.nonzero(found)
        left.append(some[row[pair]])
        right.append(word[pair] * 64 + bit)
    nothing = np.empty(0, np.int64)
    return np.concatenate([*left, nothing]), np.concatenate([*right, nothing])


def neighbours(members: DataFrame, bundle: int = BUNDLE) -> DataFrame:
    """``word, n_near, best_n, best``: for each word with near ones in a bundle of groups, their number and the most frequent."""
    order = ["length", "low", "high", "_group"]
    dealt = members.repartition("_group").sortWithinPartitions(*order)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        shape = group = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*order, "word", "n")), strict=True):
                if row[3] != group and (row[:3] != shape or len(held) >= min(bundle, BUNDLE_PLACES // (row[2] - row[1] + 1))):
                    if held:
                        yield _searched(held)
                    held, shape = [], row[:3]
                group = row[3]
                held.append(row)
        if held:
            yield _searched(held)

    return dealt.select(*order, "word", "n").mapInArrow(search, "word string, n_near long, best_n long, best string")


def _searched(rows: list[tuple]) -> pa.RecordBatch:
    length, low, high = rows[0][:3]
    rows = sorted(rows, key=lambda r: (-r[5], r[4]))  # the most frequent first, in code-point order
    words = [r[4] for r in rows]
    outside: dict[tuple[str, str], int] = {}
    group = [outside.setdefault((w[:low], w[high + len(w) - length :]), len(outside)) for w in words]
    a, b = near_pairs(words, np.array(group), length, low, high)
    longer = np.array([len(w) for w in words])[b] > length
    a, b = np.r_[a, b[longer]], np.r_[b, a[longer]]  # found from one side only
    many = np.bincount(a, minlength=len(words))
    best = np.full(len(words), len(words))
    np.minimum.at(best, a, b)
    kept = np.flatnonzero(many).tolist()
    chosen = [rows[i] for i in best[kept].tolist()]
    columns = [pa.array([words[i] for i in kept], pa.string()), pa.array(many[kept], pa.int64()), pa.array([r[5] for r in chosen], pa.int64()), pa.array([r[4] for r in chosen], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "best_n", "best"])


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of rows ``word, form``: forms followed to the last, twice as far each round.

    A form is at least ``RATIO`` times as frequent as its word, so chains are short and have no circle.
    """
    at = checkpointed(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        ahead = at.where("root <> word").select(F.col("word").alias("root"), F.col("root").alias("_ahead"))
        moved = at.join(ahead, "root", "left")
        at = checkpointed(moved.select("word", F.coalesce("_ahead", "root").alias("root"), F.col("_ahead").isNotNull().alias("_moved")))
        if at.where("_moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(words: DataFrame, group_places: int = GROUP_PLACES, bundle: int = BUNDLE) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of counted words (``word, n``), each word once."""
    words = checkpointed(words.select("word", F.col("n").cast("long").alias("n")))
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("_best")
    near = neighbours(groups(words, group_places), bundle).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    frequent = -F.col("_best.n") >= RATIO * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word", F.when(frequent, F.col("_best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, -F.col("_best.n")).alias("form_n")
    )
    formed = checkpointed(formed)
    return formed.join(roots(formed), "word").select("word", "form", "root", "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    """The variants among the words of all documents."""
    return variants(words_of(docs))
