"""Periodic runs of words, found by block convolution.

A run is a stretch of words with smallest period ``q`` and at least ``max(6, 4 * q)`` words
that no neighbouring word extends. For each scale ``b = 8, 16, 32, ...`` the words are cut into
blocks of ``b``. A run with a period of ``b`` to ``2 * b - 1`` holds a whole block together with its
repeat one period later, so the block has a zero-mismatch occurrence in the window that
follows it. The sums of squared differences between a block and all places of its window come
from one convolution, a number-theoretic transform: exact, because so many primes
are used that their product is above any sum. A distance whose sum is zero is a seed, and
is extended word by word in both directions. Periods below 8 are the base case: squared differences
of the whole text at that distance, with no transform.

Blocks are not transformed where no occurrence is possible (a word of the block does not recur
``b`` to ``2 * b - 1`` words later) or none is new (block and window lie in a known run with a period of
at most ``b / 2``, whose occurrences repeat that run); both tests are exact.

Each text is worked on by itself, whole, within one task; memory is some 100 bytes a
word of the slice of texts at hand (``SLICE_BYTES``, or one longer text). Transforms reach
``2**26`` places, which is a text of ``2**27`` words.

Defined cases: null text is empty; texts without words have no runs and an empty collapsed text;
rows with the same or no doc_id are separate; a table without rows gives none; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cdcmart.llm.common import SPACE_CLASS, slices

#: A run has this many words at least, and this many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: The first scale that is transformed; smaller periods are compared directly.
FIRST_SCALE = 8
#: Places that are transformed at once.
PLACES = 1 << 18
#: Primes with long power-of-two roots of unity, and a generator of each.
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))

RUNS = "array<struct<start: long, length: long, period: long>>"


def _mod(x: np.ndarray, prime: int) -> np.ndarray:
    p = np.uint64(prime)
    return x - x // p * p


_ROOTS: dict[tuple[int, int], np.ndarray] = {}


def _roots(prime: int, root: int, n: int) -> np.ndarray:
    """The first half of the powers of a primitive ``n``-th root of unity, kept for small ``n``."""
    if (prime, root, n) in _ROOTS:
        return _ROOTS[prime, root, n]
    out = np.ones(max(1, n // 2), np.uint64)
    done = 1
    while done < len(out):
        step = min(done, len(out) - done)
        out[done : done + step] = _mod(out[:step] * np.uint64(pow(root, done, prime)), prime)
        done += step
    if n <= PLACES:
        _ROOTS[prime, root, n] = out
    return out


def transform(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Number-theoretic transform of each row, in bit-reversed order."""
    rows = rows.copy()
    many, n = rows.shape
    w = _roots(prime, pow(generator, (prime - 1) // n, prime), n)
    half = n // 2
    while half:
        pairs = rows.reshape(many, -1, 2, half)
        a, b = pairs[:, :, 0].copy(), pairs[:, :, 1].copy()
        pairs[:, :, 0] = _mod(a + b, prime)
        pairs[:, :, 1] = _mod(_mod(a + np.uint64(prime) - b, prime) * w, prime)
        half //= 2
        w = w[::2]
    return rows


def inverse(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """What :func:`transform` was made from."""
    rows = rows.copy()
    many, n = rows.shape
    w = _roots(prime, pow(generator, prime - 1 - (prime - 1) // n, prime), n)
    half = 1
    while half < n:
        pairs = rows.reshape(many, -1, 2, half)
        a, b = pairs[:, :, 0].copy(), _mod(pairs[:, :, 1] * w[:: n // 2 // half], prime)
        pairs[:, :, 0] = _mod(a + b, prime)
        pairs[:, :, 1] = _mod(a + np.uint64(prime) - b, prime)
        half *= 2
    return _mod(rows * np.uint64(pow(n, -1, prime)), prime)


def zero_mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether block ``i`` (of ``b`` numbers) stands at place ``j`` of window ``i`` (of ``2 * b - 1``), for all ``b`` places.

    The sum of squared differences is the squares of both less twice their correlation. It is
    below ``largest ** 2 * b``, so it is zero if it is zero for primes with a larger product.
    """
    many, b = blocks.shape
    largest, bound = int(max(blocks.max(initial=0), windows.max(initial=0))), 1
    found = np.ones((many, b), bool)
    for prime, generator in PRIMES:
        left, right = np.zeros((many, 2 * b), np.uint64), np.zeros((many, 2 * b), np.uint64)
        left[:, :b] = blocks[:, ::-1]
        right[:, : 2 * b - 1] = windows
        left, right = _mod(left, prime), _mod(right, prime)
        both = inverse(_mod(transform(left, prime, generator) * transform(right, prime, generator), prime), prime, generator)
        own = _mod(np.sum(_mod(left * left, prime), axis=1), prime)
        so_far = np.zeros((many, 2 * b), np.uint64)
        np.cumsum(_mod(right[:, : 2 * b - 1] ** np.uint64(2), prime), axis=1, out=so_far[:, 1:])
        squares = _mod(so_far[:, b:] - so_far[:, :b], prime) + own[:, None]
        # the correlation's places b - 1 to 2 * b - 2 are those the circle of 2 * b does not wrap onto
        found &= _mod(squares, prime) == _mod(np.uint64(2) * both[:, b - 1 : 2 * b - 1], prime)
        bound *= prime
        if bound > largest * largest * b:
            break
    return found


class Slice:
    """Words of some texts as numbers, text after text."""

    def __init__(self, texts: list[list[bytes]]) -> None:
        lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        self.row = np.repeat(np.arange(len(texts)), lengths)
        self.lengths = lengths
        numbers = []
        for words in texts:  # from 0 in each text, so that squares stay small
            known: dict[bytes, int] = {}
            numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        self.x = np.concatenate([*numbers, np.empty(0, np.int64)])
        n = len(self.x)
        width = int(self.x.max(initial=0)) + 1
        order = np.argsort(self.row * width + self.x, kind="stable")
        same = (self.row * width + self.x)[order]
        group = np.cumsum(np.r_[False, same[1:] != same[:-1]]) if n else same
        self.group = np.empty(n, np.int64)
        self.group[order] = group
        #: (word of a text, place) as one ascending number, to look the next occurrence up
        self.places = group * (n + 1) + order
        last = order[np.r_[np.flatnonzero(np.diff(group)), n - 1]] if n else order
        self.reach = last[self.group] - np.arange(n)

    def short_periods(self) -> Iterator[np.ndarray]:
        """Rows of start, length and period of the runs with a period below ``FIRST_SCALE`` (and of stretches with a smaller one)."""
        for q in range(1, FIRST_SCALE):
            difference = self.x[q:] - self.x[:-q]
            equal = (difference * difference == 0) & (self.row[q:] == self.row[:-q])
            edges = np.flatnonzero(np.diff(np.r_[False, equal, False]))
            start, stop = edges[::2], edges[1::2]
            kept = stop - start + q >= max(LEAST_WORDS, LEAST_PERIODS * q)
            yield np.stack([start[kept], (stop - start)[kept] + q, np.full(kept.sum(), q)], axis=1)

    def seeds(self, b: int, known: np.ndarray) -> np.ndarray:
        """Rows of place and distance at which a block of ``b`` words recurs, but for those that repeat a known run."""
        n = len(self.x)
        at = np.arange(0, n - 2 * b + 1, b)
        # in one text that is long enough for a run, and with room for a repeat
        at = at[(self.lengths[self.row[at]] >= LEAST_PERIODS * b) & (at + 2 * b <= self.ends[self.row[at]])]
        if len(at):
            at = at[np.minimum.reduceat(self.reach, np.stack([at, at + b], axis=1).ravel())[::2] >= b]
        held = known[(known[:, 1] >= 2 * b) & (2 * known[:, 2] <= b)]
        change = np.zeros(len(at) + 1, np.int64)
        low, high = np.searchsorted(at, held[:, 0]), np.searchsorted(at, held[:, 0] + held[:, 1] - 3 * b + 1, "right")
        np.add.at(change, low, high > low)
        np.subtract.at(change, np.maximum(low, high), high > low)
        at = at[np.cumsum(change[:-1]) == 0]
        if len(at):
            at = at[self._recurs(at, b)]
        found = []
        step = max(1, PLACES // (2 * b))
        padded = np.r_[self.x, np.zeros(3 * b, np.int64)].astype(np.uint64) if len(at) else None
        for some in (at[i : i + step] for i in range(0, len(at), step)):
            equal = zero_mismatches(padded[some[:, None] + np.arange(b)], padded[some[:, None] + np.arange(b, 3 * b - 1)])
            block, place = np.nonzero(equal)
            found.append(np.stack([some[block], place + b], axis=1))
        seeds = np.concatenate([*found, np.empty((0, 2), np.int64)])
        seeds = seeds[seeds.sum(axis=1) + b <= self.ends[self.row[seeds[:, 0]]]]
        new = np.ones(len(seeds), bool)  # seeds are in order of their places
        low, high = np.searchsorted(seeds[:, 0], held[:, 0]), np.searchsorted(seeds[:, 0], held[:, 0] + held[:, 1] - 2 * b, "right")
        for k in np.flatnonzero(high > low).tolist():
            (start, length, q), some = held[k].tolist(), slice(low[k], high[k])
            s, d = seeds[some, 0], seeds[some, 1]
            new[some] &= (s + d + b > start + length) | (d % q > 0)
        seeds = seeds[new]
        return seeds[np.lexsort((seeds[:, 0], seeds[:, 1]))]

    def _recurs(self, at: np.ndarray, b: int) -> np.ndarray:
        """Whether each word of the blocks stands again ``b`` to ``2 * b - 1`` words later."""
        n = len(self.x)
        spots = at[:, None] + np.arange(b)
        group = self.group[spots]
        following = np.searchsorted(self.places, group * (n + 1) + spots + b)
        place = np.r_[self.places, np.iinfo(np.int64).max][following]
        return (place < group * (n + 1) + np.minimum(spots + 2 * b, n)).all(axis=1)

    def extended(self, s: int, d: int, b: int) -> tuple[int, int]:
        """First place and end of the stretch around ``s`` in which words ``d`` apart are the same."""
        low, high = int(self.begins[self.row[s]]), int(self.ends[self.row[s]]) - d
        x, end, step = self.x, s + b, 64
        while end < high:
            stop = min(end + step, high)
            other = np.flatnonzero(x[end:stop] != x[end + d : stop + d])
            if len(other):
                end += int(other[0])
                break
            end, step = stop, 2 * step
        start, step = s, 64
        while start > low:
            stop = max(start - step, low)
            other = np.flatnonzero(x[stop:start] != x[stop + d : start + d])
            if len(other):
                start = stop + int(other[-1]) + 1
                break
            start, step = stop, 2 * step
        return start, end + d

    def runs(self) -> list[list[tuple[int, int, int]]]:
        """Start (in its text), length and period of the runs of each text, by start and period."""
        known = np.concatenate([np.empty((0, 3), np.int64), *self.short_periods()])
        b = FIRST_SCALE
        while LEAST_PERIODS * b <= self.lengths.max(initial=0):
            new, before, start, stop = [], 0, 0, 0
            for s, d in self.seeds(b, known).tolist():
                if d == before and start <= s and s + b + d <= stop:
                    continue  # the same stretch
                start, stop = self.extended(s, d, b)
                before = d
                if stop - start >= LEAST_PERIODS * d:
                    new.append((start, stop - start, d))
            known = np.concatenate([known, np.array(new, np.int64).reshape(-1, 3)])
            b *= 2
        known = known[np.lexsort((known[:, 2], known[:, 1], known[:, 0]))]
        if len(known):  # a stretch has the smallest of its periods
            known = known[np.r_[True, (known[1:, :2] != known[:-1, :2]).any(axis=1)]]
            known = known[np.lexsort((known[:, 2], known[:, 0]))]
        out: list[list[tuple[int, int, int]]] = [[] for _ in self.lengths]
        for start, length, q in known.tolist():
            text = self.row[start]
            out[text].append((start - int(self.begins[text]), length, q))
        return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, each run with its first period only."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row: its runs, and its text with one period of each."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for start, stop in slices(column):
                texts = [(t or "").encode().split() for t in column.slice(start, stop - start).to_pylist()]
                runs = Slice(texts).runs()
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                short = [collapsed(w, r).decode() for w, r in zip(texts, runs, strict=True)]
                columns = [batch.column("doc_id").slice(start, stop - start), pa.array([len(t) for t in texts], pa.int64()), pa.array(rows, kind), pa.array(short, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    chosen = docs.select("doc_id", "text")
    return chosen.mapInArrow(search, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the end of every tenth text made periodic, by a checksum of doc_id (rows without one stay as they are)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", f"{SPACE_CLASS}+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("_h")).withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
    n, g = F.size("_words").cast("long"), F.floor(F.col("_h") / 10)
    rows = rows.withColumns({"_n": F.when(n > 0, n), "_g": g}).withColumn("_a", F.col("_g") % F.col("_n"))
    rows = rows.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    place = lambda i: (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")
    tail = F.transform(F.sequence(F.col("_a"), F.col("_n") - 1), lambda i: F.get(F.col("_words"), place(i)))
    text = F.concat_ws(" ", F.slice("_words", F.lit(1), F.col("_a").cast("int")), tail)
    return rows.select("doc_id", F.when(F.col("_n").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def longest(runs: Column) -> Column:
    """The run with the greatest length by period (the first of equals); fractions are compared by whole numbers."""
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r.length * best.period > best.length * r.period, r).otherwise(best))


def report(docs: DataFrame) -> DataFrame:
    """The runs of every row of :func:`with_periodic_tails`, as counts, the longest one and digests."""
    rows = find(with_periodic_tails(docs)).withColumn("_best", longest(F.col("runs")))
    line = lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "_best.start",
        "_best.length",
        "_best.period",
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
