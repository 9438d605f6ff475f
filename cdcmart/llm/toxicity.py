"""Toxicity: maximum-scoring segments of token log-odds.

* Tokens are runs of letters and marks of the decoded text in lower case; every other sign
  ends one. In scripts written without spaces each position begins a token of ``GRAMS`` signs.
* Evidence of a token: log-odds of the whole token between toxic and other labelled
  documents, with Dirichlet priors as strong as the token is frequent in the whole corpus. A
  prior leans on the other tokens with the same first ``LONG`` letters: a beginning smooths
  what a token shows and does not gate it.
* A linear scan (all maximal scoring subsequences, after Ruzzo and Tompa) finds every
  passage of a document whose evidence cannot be raised by growing or shrinking it.
* Extreme-value statistics (Karlin and Altschul) tell what a best passage scores by
  chance in a text of that length: ``lambda`` is solved from the score distribution of
  the non-toxic documents, ``n exp(-lambda s)`` passages as good are expected. Those expected
  less than once count together, by the probability of their sum (Karlin and Altschul's
  sum statistic); if that is above ``EXPECTED``, the text has no evidence.

The model is a table of a row for each token, as long as the corpus has tokens, and is joined to
the tokens documents have: first those that may speak for toxicity (by a Bloom filter of ``BITS``
bits, which lets too many through at worst), then, where these alone would make a passage, the rest. Background counts take every token of
every document; labels are at most ``LABELLED`` rows, those with the smallest hashes.

Defined cases: null text is empty; a text without letters has no passage and scores
the prior's floor; labels may be missing, null or repeated (toxic if any says so);
without toxic labels nothing has evidence; repeated rows score alike.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cdcmart.llm.common import _GOLDEN, checkpointed, maybe_in, mixed, powers, skew_join, slices, text_bytes, written

BITS = 27  # of a token's hash, to a place of the filter
LABELLED = 200_000
HELD_OUT = 2
THRESHOLD = 0.3
#: Length in letters of the beginning that tokens share.
LONG = 6
#: Least prior mass of a token; share of the labelled tokens that the corpus prior weighs; cost of a token without evidence.
PRIOR_MASS, CORPUS_SHARE, COST = 1.0, 0.1, 0.2
#: A token below this much evidence has none: three toxic documents alone reach it.
LEAST = 1.9
#: The passages of a text count if chance gives passages as good with this probability at most.
EXPECTED = 0.05
#: Scripts without spaces: signs of a token, and the ranges of Thai to Lao, Myanmar, Khmer, kana, and Han.
GRAMS = {
    4: ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF)),
    2: ((0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x323AF)),
}

PASSAGES = "array<struct<start:bigint,stop:bigint,evidence:double>>"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT, F.lit(False))


@cache
def _signs() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: 0 if it ends a token, 1 for a letter or mark, else the length of its script's tokens; and a number, alike for both cases."""
    kind = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), np.uint8, 0x110000)
    for length, ranges in GRAMS.items():
        for low, high in ranges:
            kind[low : high + 1] *= length
    lower = np.arange(0x110000, dtype=np.uint64)
    for c in np.flatnonzero(kind == 1).tolist():
        small = chr(c).lower()
        lower[c] = ord(small) if len(small) == 1 else c
    return kind, mixed((lower + np.uint64(1)) * _GOLDEN)


def _decoded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and where each begins (one entry more); stray bytes end a token."""
    if not (data >= 128).any():
        return data, np.arange(len(data) + 1)
    first = (data & 0xC0) != 0x80
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(first)
    lead = data[at].astype(np.uint32)
    points = lead.copy()
    for low, high, more in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0xF8, 3)):
        some = np.flatnonzero((lead >= low) & (lead < high))
        value = lead[some] & (0x3F >> more)
        for k in range(1, more + 1):
            value = (value << 6) | (data[np.minimum(at[some] + k, len(data) - 1)] & 0x3F)
        points[some] = value
    points[(points >= 0x110000) | ((lead >= 0x80) & (lead < 0xC0))] = 0
    return points, np.append(at, len(data))


def _tokens(data: np.ndarray, offsets: np.ndarray, beginning: bool = False) -> tuple[np.ndarray, ...]:
    """Row, first byte, end and hash of every token; if asked, the hash of its beginning."""
    points, places = _decoded(data, offsets)
    kinds, numbers = _signs()
    kind = kinds[points]
    change = np.ones(len(kind) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[np.searchsorted(places, offsets)] = True
    edges = np.flatnonzero(change)
    begin, end = edges[:-1], edges[1:]
    some = kind[begin] > 0 if len(kind) else np.zeros(0, bool)
    begin, end = begin[some], end[some]
    length = kind[begin].astype(np.int64)
    if (length > 1).any():  # a token from each position of the run that has room for one, at least one
        many = np.where(length > 1, np.maximum(end - begin - length + 1, 1), 1)
        run = np.repeat(np.arange(len(begin)), many)
        step = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
        stop = end[run]
        begin = begin[run] + step
        end = np.where(length[run] > 1, np.minimum(begin + length[run], stop), stop)
    up, down = powers(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(numbers[points] * up[:-1], out=total[1:])

    def hashed(most: int | None) -> np.ndarray:
        stop = np.minimum(begin + most, end) if most else end
        return mixed((total[stop] - total[begin]) * down[begin] + np.uint64(most or 0) ^ _GOLDEN).view(np.int64)

    found = (np.searchsorted(offsets, places[begin], side="right") - 1, places[begin], places[end], hashed(None))
    return (*found, hashed(LONG)) if beginning else found


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    column = batch.column("text")
    for start, stop in slices(column):
        yield (start, stop, *text_bytes(column.slice(start, stop - start)))


def labelled(labels: DataFrame, most: int = LABELLED) -> dict[int, int]:
    """Labels to learn from: not held out, at most ``most``, those with the smallest hashes."""
    rows = labels.where(~held_out(F.col("doc_id"))).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    rows = rows.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return {r["doc_id"]: r["toxic"] for r in rows.collect()}


@dataclass
class Scale:
    """``lam`` scales evidence to nats of surprise; ``prior`` is the share of toxic documents."""

    lam: float = 1.0
    prior: float = 0.1

    def score(self, kept: list[dict]) -> float:
        """Prior odds times the surprise of all passages together; a text without evidence stays below the prior."""
        surprise = -1.0
        if kept:
            r, total = len(kept), sum(x["evidence"] for x in kept)
            chance = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
            surprise = -chance if chance <= math.log(EXPECTED) else surprise
        odds = math.log(self.prior / (1 - self.prior)) + surprise
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


@dataclass
class Model:
    """``evidence``: rows ``token, evidence`` of all tokens whose evidence is not that of an unknown one (``-COST``)."""

    evidence: DataFrame
    scale: Scale


def _counts(docs: DataFrame, classes: dict[int, int]) -> DataFrame:
    """``token, six, other, toxic, every``: of each token its beginning and the documents that have it, by class and all."""
    known = np.array(sorted(classes), dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((known, np.array([classes[i] for i in known.tolist()], dtype=np.int64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, toxic = shared.value
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            missing = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0))
            kind = np.full(len(ids), 2)
            if len(known):
                at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
                found = (known[at] == ids) & ~missing
                kind[found] = toxic[at[found]]
            for start, _, data, offsets in _texts(batch):
                row, _, _, token, six = _tokens(data, offsets, beginning=True)
                # a document counts once for a token, so that its own names and repetitions are no evidence
                order = np.lexsort((row, token))
                order = order[np.append(True, (np.diff(token[order]) != 0) | (np.diff(row[order]) != 0))[: len(order)]]
                token, row, six = token[order], row[order], six[order]
                unique, one, which = np.unique(token, return_index=True, return_inverse=True)
                of = kind[start + row]
                sums = [np.bincount(which[keep], minlength=len(unique)) for keep in (of == 0, of == 1, slice(None))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (unique, six[one], *(n.astype(np.int64) for n in sums))], names=["token", "six", "other", "toxic", "every"]
                )

    rows = docs.select("doc_id", "text").mapInArrow(count, "token long, six long, other long, toxic long, every long")
    return rows.groupBy("token").agg(F.first("six").alias("six"), *(F.sum(c).alias(c) for c in ("other", "toxic", "every")))


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    classes = labelled(labels, most)
    counts = checkpointed(_counts(docs, classes))
    other, toxic, every = (n or 0 for n in counts.agg(F.sum("other"), F.sum("toxic"), F.sum("every")).first())
    if not toxic or not other:
        return Model(counts.where("false").select("token", F.lit(0.0).alias("evidence")), Scale())
    level, weight = toxic / other, CORPUS_SHARE * (toxic + other) / every

    def share(names: list[Column], parent: Column) -> Column:
        o, t, e = names
        mass = F.greatest(F.lit(PRIOR_MASS), e * (weight * level))
        return (t + mass * parent) / (t + o * level + mass)

    kinds = ("other", "toxic", "every")
    # a beginning counts what the token itself does not count already; without labelled documents it says nothing
    by_six = counts.groupBy("six").agg(*(F.sum(c).alias(f"{c}6") for c in kinds)).where("other6 + toxic6 > 0")
    rows = skew_join(counts, by_six, "six").withColumn("_share6", share([F.col(f"{c}6") - F.col(c) for c in kinds], F.lit(0.5)))

    def evidence(other: Column) -> Column:
        part = share([other, F.col("toxic"), F.col("every")], F.col("_share6"))
        odds = F.log(part) - F.log1p(-part)
        return F.when(odds >= LEAST, odds).otherwise(F.least(odds, F.lit(0.0))) - COST

    # what a token would say to one more document that has it, as told by the others
    unseen = evidence(F.greatest(F.col("other") - 1, F.lit(0)))
    rows = checkpointed(rows.select("token", "other", "toxic", evidence(F.col("other")).alias("evidence"), F.round(unseen, 3).alias("unseen")))
    rate = sum(classes.values()) / len(classes)
    steps = rows.groupBy("unseen").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toPandas()
    # Scores of tokens in other documents, each left out of its own evidence; half a token as in toxic ones stands for what was not seen.
    lam = _lambda(steps["unseen"].to_numpy(float), steps["other"].to_numpy(float) + 0.5 * steps["toxic"].to_numpy(float) / toxic)
    return Model(rows.where(F.col("evidence") != -COST).select("token", "evidence"), Scale(lam, min(max(rate, 0.01), 0.5)))


def _lambda(e: np.ndarray, chance: np.ndarray) -> float:
    """The positive solution of ``sum(chance * exp(lambda e)) = 1``; 1 if there is none."""
    chance = chance / chance.sum()
    if not (e > 0).any() or (chance * e).sum() >= 0:
        return 1.0
    low, high = 1e-3, 50.0
    for _ in range(60):
        middle = (low + high) / 2
        if np.log(chance[chance > 0]).max() + (middle * e).max() > 600 or (chance * np.exp(np.minimum(middle * e, 600))).sum() > 1:
            high = middle
        else:
            low = middle
    return low


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences of ``scores`` as (first, end, sum), in linear time.

    Only the positive scores are visited; a running sum stands for what lies between.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum after
    lower: list[int] = []  # the last segment before each that begins at a smaller sum
    for i in np.flatnonzero(scores > 0).tolist():
        first, left, right = i, total[i], total[i + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = lower[j]
            if j < 0 or found[j][3] >= right:
                break
            first, left = found[j][0], found[j][2]
            del found[j:], lower[j:]
        found.append((first, i + 1, left, right))
        lower.append(j)
    return [(a, b, float(r - le)) for a, b, le, r in found]


def _evidence(n: int, places: np.ndarray, tokens: np.ndarray, known: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Evidence of the tokens of a text of ``n``: of ``tokens`` at ``places``, the ``weights`` of those ``known`` (sorted), ``-COST`` else."""
    e = np.full(n, -COST)
    if len(known):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        e[places] = np.where(known[at] == tokens, weights[at], -COST)
    return e


def _passages(scale: Scale, e: np.ndarray) -> list[tuple[int, int, float]]:
    """Passages of a text that exceed what chance gives in a text of that length."""
    chance = math.log(len(e)) if len(e) else 0.0
    return [(a, b, x) for a, b, s in segments(e) if (x := scale.lam * s - chance) > 0]


def _significant(scale: Scale, data: np.ndarray, offsets: np.ndarray, known: np.ndarray, weights: np.ndarray) -> list[dict]:
    _, begin, end, token = _tokens(data, offsets)
    e = _evidence(len(token), np.arange(len(token)), token, known, weights)
    return [{"start": int(begin[a]), "stop": int(end[b - 1]), "evidence": x} for a, b, x in _passages(scale, e)]


def _filter(evidence: DataFrame) -> np.ndarray:
    """The tokens that speak for toxicity as a Bloom filter of one hash: the first ``BITS`` bits of a token are its place."""
    word, bit = F.shiftrightunsigned("token", 64 - BITS + 6), F.shiftrightunsigned("token", 64 - BITS).bitwiseAND(F.lit(63)).cast("int")
    rows = evidence.where("evidence > 0").groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).toPandas()
    words = np.zeros(1 << (BITS - 6), np.int64)
    words[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return words.view(np.uint64)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_key"))


def _asked(docs: DataFrame, evidence: DataFrame) -> DataFrame:
    """``doc_id, _key, n_tokens, places, tokens`` of every row: numbers and hashes of the tokens that may speak for toxicity, null without any."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(evidence))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            for start, stop, data, offsets in _texts(batch):
                row, _, _, token = _tokens(data, offsets)
                at = token.view(np.uint64) >> np.uint64(64 - BITS)
                hit = np.flatnonzero((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))
                bounds = np.searchsorted(row, np.arange(len(offsets)))
                cuts = np.searchsorted(hit, bounds)
                spans = [hit[a:b] if b > a else None for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                places = [None if x is None else x - bounds[r] for r, x in enumerate(spans)]
                tokens = [None if x is None else token[x] for x in spans]
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("_key"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(places, pa.list_(pa.int64())), pa.array(tokens, pa.list_(pa.int64()))],
                    names=["doc_id", "_key", "n_tokens", "places", "tokens"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(_keyed(docs).mapInArrow(ask, f"doc_id {kind}, _key long, n_tokens long, places array<long>, tokens array<long>"), "toxic-asked")


def _likely(asked: DataFrame, model: Model) -> DataFrame:
    """``_mark``: keys of the texts that have a passage if no token speaks against it; the others have none."""
    some = asked.where("tokens IS NOT NULL").dropDuplicates(["_key"])
    each = some.select("_key", F.explode(F.array_distinct("tokens")).alias("token"))
    given = skew_join(each, model.evidence.where("evidence > 0"), "token").groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("token", "evidence"))).alias("given"))
    rows = some.join(given, "_key").select("_key", "n_tokens", "places", "tokens", F.col("given.token").alias("known"), F.col("given.evidence").alias("weights"))
    scale = model.scale

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = np.zeros(batch.num_rows, bool)
            for i, n in enumerate(batch.column("n_tokens").to_pylist()):
                places, tokens, known, weights = (np.asarray(batch.column(c)[i].values) for c in ("places", "tokens", "known", "weights"))
                stays[i] = bool(_passages(scale, _evidence(n, places, tokens, known, weights)))
            yield pa.RecordBatch.from_arrays([batch.column("_key").filter(pa.array(stays))], names=["_mark"])

    return checkpointed(rows.mapInArrow(bound, "_mark long"))


def _found(docs: DataFrame, model: Model, asked: DataFrame) -> DataFrame:
    """``_key, passages, score`` of the texts with passages, once each."""
    likely = _likely(asked, model)
    # an inner join (keys are there once): Spark would push a semi join below the filter and shuffle every text
    texts = maybe_in(_keyed(docs), likely, "_key", "_mark").join(likely, F.col("_key") == F.col("_mark")).dropDuplicates(["_key"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in _texts(batch):
                row, _, _, token = _tokens(data, offsets)
                bounds = np.searchsorted(row, np.arange(len(offsets)))
                tokens = [np.unique(token[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part.column("_key"), part.column("text"), pa.array(tokens, pa.list_(pa.int64()))], names=["_key", "text", "tokens"])

    texts = texts.select("_key", "text").mapInArrow(tell, "_key long, text string, tokens array<long>")
    texts = written(texts, "toxic-candidates")
    given = skew_join(texts.select("_key", F.explode("tokens").alias("token")), model.evidence, "token")
    given = given.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("token", "evidence"))).alias("given"))
    rows = texts.select("_key", "text").join(given, "_key").select("_key", "text", F.col("given.token").alias("known"), F.col("given.evidence").alias("weights"))
    scale = model.scale

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("evidence", pa.float64())]))
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                known, weights = (np.asarray(batch.column(c)[i].values) for c in ("known", "weights"))
                found.append(_significant(scale, *text_bytes(batch.column("text").slice(i, 1)), known, weights))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(found, type=kind), pa.array([scale.score(x) for x in found], pa.float64())], names=["_key", "passages", "score"]
            )

    return checkpointed(rows.mapInArrow(scan, f"_key long, passages {PASSAGES}, score double").where(F.size("passages") > 0))


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, passages, score`` of every row; ``start`` and ``stop`` of a passage are bytes of its UTF-8 text."""
    asked = _asked(docs, model.evidence)
    none = F.array().cast(PASSAGES)
    floor = F.lit(model.scale.score([]))
    some = asked.where("tokens IS NOT NULL").drop("tokens", "places").join(_found(docs, model, asked), "_key", "left")
    some = some.select("doc_id", "n_tokens", F.coalesce("passages", none).alias("passages"), F.coalesce("score", floor).alias("score"))
    return asked.where("tokens IS NULL").select("doc_id", "n_tokens", none.alias("passages"), floor.alias("score")).union(some)


def report(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_tokens, n_passages`` of every row of ``docs``."""
    scored = passages(docs, learn(docs, labels, most))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "n_tokens", F.size("passages").alias("n_passages"),
    )


def clean(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    model = learn(docs, labels, most)
    toxic = _found(docs, model, _asked(docs, model.evidence)).where(F.col("score") >= THRESHOLD).select(F.col("_key").alias("_mark"))
    rows = docs.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("_row"), F.xxhash64("doc_id", "text").alias("_of"))
    same = maybe_in(rows, toxic, "_of", "_mark", keep=False)
    rest = maybe_in(rows, toxic, "_of", "_mark").join(toxic, F.col("_of") == F.col("_mark"), "left").where("_mark IS NULL")
    return same.select("_row").union(rest.select("_row")).select("_row.*")
