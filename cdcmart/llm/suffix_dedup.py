"""Suffix-array dedup: remove every byte covered by a string of ``MATCH`` bytes that also starts elsewhere.

1. *Anchors.* Of the ``GRAM``-byte strings inside a window of ``MATCH`` bytes the one with
   the least hash (the first of equals) is its anchor. Equal windows have equal anchors at
   equal places, so a window can only repeat if its anchor does. Anchors that occur once
   in the corpus are dropped with their windows; what follows sees only the rest.
2. *Shards.* The windows of an anchor and their text (a piece) go to the shard of that
   anchor; equal pieces travel once from each slice. Anchors with more than ``HOT``
   pieces are salted over several shards.
3. *Suffix arrays.* In each shard the windows are sorted by prefix doubling that refines
   only groups still equal (Larsson and Sadakane), to ``MATCH`` bytes; common prefixes of
   neighbours follow in text order, each from the one before (Kasai).
4. *Across shards.* Sorted runs of the windows of salted anchors are cut at the bounds of
   digest ranges by binary search and merged range by range.
5. Covered ranges are merged per document; the text is cut.

Windows of different documents are compared byte by byte within a shard, by 64-bit digests
across the shards of a salted anchor. Nothing is sampled or capped.

Defined cases: null text is empty; texts shorter than ``MATCH`` lose nothing; a row repeated
(same doc_id and text) repeats its windows; doc_id may be null; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdcmart.llm.common import _BYTE_VALUES, checkpointed, maybe_in, mixed, powers, skew_join, slices, text_bytes, written

MATCH = 400
GRAM = 96
#: Pieces of an anchor that one shard takes.
HOT = 3000
#: Bytes of text that are sorted at once, and of a slice in which anchors are looked for.
SHARD_BYTES = 2 << 20
SLICE = 2 << 20
#: Digest ranges of the merge across shards.
RANGES = 256


def _rolling(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit number for each string of ``length`` bytes."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:-1], out=total[1:])
    n = max(0, len(data) - length + 1)
    return mixed((total[length:] - total[:n]) * down[:n]) if n else np.empty(0, np.uint64)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window (a place in the row), number of windows and hash of each anchor."""
    if len(data) < MATCH:
        return (np.empty(0, np.int64),) * 4
    grams = _rolling(data, GRAM)
    bits = np.uint64(max(20, len(data).bit_length()))
    keys = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    at = (_least(keys, MATCH - GRAM + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[: len(at)] == row[MATCH - 1 : MATCH - 1 + len(at)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (at[1:] != at[:-1]) | (row[1 : len(at)] != row[: len(at) - 1])
    first = np.flatnonzero(begins)
    group = np.cumsum(begins) - 1
    number = np.bincount(group[inside], minlength=len(first))
    return row[first], first - offsets[row[first]], number, grams[at[first]].view(np.int64)


def _anchors(docs: DataFrame) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column("text"), SLICE):
                keys = np.asarray(batch.column("_key").slice(start, stop - start))
                row, first, number, anchor = anchors_of(*text_bytes(batch.column("text").slice(start, stop - start)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array(first), pa.array(number.astype(np.int32)), pa.array(anchor)], names=["_key", "first", "number", "anchor"])

    return docs.mapInArrow(find, "_key long, first long, number int, anchor long")


def _pieces(marked: DataFrame, hot: int) -> DataFrame:
    """Pieces of the marked documents by shard; ``owners`` are pairs of document key and place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}
        size = 0
        for batch in batches:
            for key, text, marks in zip(batch.column("_key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("marks").to_pylist(), strict=True):
                for m in {(m["first"], m["number"], m["anchor"], m["many"]) for m in marks}:
                    first, number, anchor, many = m
                    piece = text[first : first + number - 1 + MATCH]
                    salts = -(-many // hot)
                    owners = held.setdefault((anchor, (key % salts) if salts > 1 else 0, salts > 1, piece), [])
                    if not owners:
                        size += len(piece)
                    owners += (key, first)
                if size > 16 << 20:
                    yield _packed(held)
                    held, size = {}, 0
        yield _packed(held)

    return marked.select("_key", "text", "marks").mapInArrow(cut, "shard long, hot boolean, owners binary, piece binary")


def _packed(held: dict[tuple, list[int]]) -> pa.RecordBatch:
    keys = list(held)
    with np.errstate(over="ignore"):
        shard = mixed(np.array([k[0] for k in keys], np.int64).view(np.uint64) + np.array([k[1] for k in keys], np.uint64)).view(np.int64)
    columns = [pa.array(shard), pa.array([k[2] for k in keys], pa.bool_()), pa.array([np.array(o, np.int64).tobytes() for o in held.values()], pa.binary()), pa.array([k[3] for k in keys], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "hot", "owners", "piece"])


def _regroup(order_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, where each group of equals begins (for every entry), and the size of its group."""
    order = np.argsort(order_keys, kind="stable")
    ordered = order_keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    heads = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    return order, heads[group], np.diff(np.append(heads, len(order)))[group]


def suffix_array(text: np.ndarray, starts: np.ndarray, room: np.ndarray) -> np.ndarray:
    """``starts`` in order of their first ``MATCH`` bytes.

    ``room``: bytes from each place of the text to the end of its piece, which a
    comparison does not pass. Ranks double their length, and only places whose
    rank is shared are sorted again.
    """
    n = len(text)
    words = words_of(text)
    places = np.flatnonzero(room >= 8)
    rank = np.zeros(n, np.int64)
    order, head, size = _regroup(words[places])
    rank[places[order]] = head
    active, length = places[order][size > 1], 8
    while length < 256:
        active = active[room[active] >= 2 * length]
        if len(active):
            active = _refine(rank, active, length, n)
        length *= 2
    active = active[room[active] >= MATCH]
    if len(active):
        _refine(rank, active, MATCH - length, n)
    return starts[np.argsort(rank[starts], kind="stable")]


def _refine(rank: np.ndarray, active: np.ndarray, ahead: int, n: int) -> np.ndarray:
    """Split groups of equal rank by the rank ``ahead`` of each place; returns the places still in a group."""
    order, head, size = _regroup(rank[active] * n + rank[active + ahead])
    ordered = active[order]
    old = rank[ordered]
    begin = np.concatenate([[True], old[1:] != old[:-1]])
    base = np.flatnonzero(begin)[np.cumsum(begin) - 1]
    rank[ordered] = old + head - base
    return ordered[size > 1]


def words_of(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number whose order is theirs; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out |= padded[j : j + len(text)] << np.uint64(56 - 8 * j)
    return out


def common_prefixes(text: np.ndarray, ordered: np.ndarray, first: np.ndarray, number: np.ndarray) -> np.ndarray:
    """For each window, the bytes (``MATCH`` at most) it shares with its predecessor in ``ordered``.

    Kasai: along a text, the common prefix shrinks by one at most from window to
    window, as long as the predecessor's next window also comes before. All pieces are
    walked at once, ``first`` and ``number`` being their windows.
    """
    words = words_of(text)
    place = np.full(len(text) + 1, -1, np.int64)
    place[ordered] = np.arange(len(ordered))
    shared = np.zeros(len(ordered), np.int64)
    before = np.zeros(len(first), np.int64)
    partner = np.full(len(first), -1, np.int64)
    for step in range(int(number.max(initial=0))):
        mine = np.flatnonzero(number > step)
        i = first[mine] + step
        p = place[i]
        j = np.where(p > 0, ordered[p - 1], -1)
        follows = (partner[mine] >= 0) & (place[partner[mine] + 1] >= 0) & (place[partner[mine] + 1] < p)
        h = np.where(follows, np.maximum(before[mine] - 1, 0), 0)
        todo = np.flatnonzero((j >= 0) & (h < MATCH))
        while len(todo):
            differs = words[i[todo] + h[todo]] ^ words[j[todo] + h[todo]]
            same = differs == 0
            h[todo] = np.minimum(h[todo] + np.where(same, 8, _leading(differs)), MATCH)
            todo = todo[same & (h[todo] < MATCH)]
        shared[np.maximum(p, 0)] = np.where(j >= 0, h, 0)
        before[mine], partner[mine] = h, j
    return shared


def _leading(x: np.ndarray) -> np.ndarray:
    """Whole zero bytes at the head of each number."""
    out = np.zeros(len(x), np.int64)
    for j in range(1, 8):
        out += (x >> np.uint64(64 - 8 * j)) == 0
    return out


def _repeats(pieces: list[bytes], several: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For windows of the pieces (in text order): piece, place in it, repeated or not, class, and digest."""
    text = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.array([len(p) for p in pieces])
    ends = np.cumsum(lengths)
    number = lengths - MATCH + 1
    first = ends - lengths
    room = np.repeat(ends, lengths) - np.arange(len(text))
    starts = np.flatnonzero(room >= MATCH)
    ordered = suffix_array(text, starts, room)
    shared = common_prefixes(text, ordered, first, number)
    equal = shared >= MATCH
    class_of = np.cumsum(~equal) - 1
    piece = np.repeat(np.arange(len(pieces)), number)
    at = np.empty(len(text), np.int64)
    at[ordered] = class_of
    classes = at[starts]
    count = np.bincount(classes, weights=1.0 + several[piece])
    return piece, starts - first[piece], count[classes] > 1, classes, _rolling(text, MATCH)[starts]


def _search(pieces: DataFrame) -> DataFrame:
    """Ranges ``_key, start, stop`` that repeat within a shard; windows of salted anchors that may repeat in another have ``digest``."""

    def work(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        distinct: dict[bytes, list] = {}
        groups: dict[int, int] = {}
        for shard, hot, owners, piece in rows:
            if piece not in distinct:
                distinct[piece] = [[], hot, shard]
                groups[shard] = groups.get(shard, 0) + 1
            distinct[piece][0].append(owners)
        out: list[list[np.ndarray]] = [[], [], [], []]

        def put(key, start, stop, digest=None) -> None:
            for column, x in zip(out, (key, start, stop, np.zeros(len(key), np.int64) if digest is None else digest), strict=True):
                column.append(x)

        alone, sorted_pieces = [], []
        for piece, (owners, hot, shard) in distinct.items():
            owners = np.frombuffer(b"".join(owners), np.int64).reshape(-1, 2)
            (sorted_pieces if hot or groups[shard] > 1 else alone).append((piece, owners, hot, shard))
        for piece, owners, _, _ in alone:
            if len(owners) > 1:
                put(owners[:, 0], owners[:, 1], owners[:, 1] + len(piece))
        if sorted_pieces:
            several = np.array([float(len(o) > 1) for _, o, _, _ in sorted_pieces])
            of, place, repeated, classes, digest = _repeats([p[0] for p in sorted_pieces], several)
            cuts = np.searchsorted(of, np.arange(len(sorted_pieces) + 1))
            hots = np.array([p[2] for p in sorted_pieces])
            told = np.zeros(len(of), bool)  # one window of each class tells the other shards of it
            if hots.any():
                _, heads = np.unique(classes, return_index=True)
                told[heads] = True
                told &= hots[of]
            for k, (_, owners, hot, _) in enumerate(sorted_pieces):
                here = repeated[cuts[k] : cuts[k + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], here, [False]]).astype(np.int8)))
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    put(owners[:, 0], owners[:, 1] + a, owners[:, 1] + b - 1 + MATCH)
                if hot:
                    w = np.flatnonzero(told[cuts[k] : cuts[k + 1]])
                    at = owners[0, 1] + w
                    put(np.full(len(w), owners[0, 0]), at, at + MATCH, digest[cuts[k] + w].view(np.int64) | 1)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["_key", "start", "stop", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "hot", "owners", "piece")), strict=True):
                if size > SHARD_BYTES and row[0] != last:
                    yield from work(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
                last = row[0]
        yield from work(rows)

    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(parts, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "_key long, start long, stop long, digest long")


def _across(windows: DataFrame) -> DataFrame:
    """Of the windows that shards told of, those that two shards or more have."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.linspace(np.iinfo(np.int64).min, np.iinfo(np.int64).max, RANGES + 1)[1:-1]
        for batch in batches:
            batch = batch.sort_by("digest")
            cuts = [0, *np.searchsorted(np.asarray(batch.column("digest")), bounds).tolist(), batch.num_rows]
            runs = [(k, batch.slice(a, b - a)) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            columns = [pa.array([np.asarray(r.column(c)).tobytes() for _, r in runs], pa.binary()) for c in ("digest", "_key", "start")]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in runs], pa.int32()), *columns], names=["range", "digest", "_key", "start"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                digest, key, start = (np.concatenate([np.frombuffer(h[c], np.int64) for h in held]) for c in range(3))
                ordered = np.sort(digest)
                twice = np.searchsorted(ordered, digest, "right") - np.searchsorted(ordered, digest, "left") > 1
                yield pa.RecordBatch.from_arrays([pa.array(key[twice]), pa.array(start[twice])], names=["_key", "start"])
                held.clear()

        for batch in batches:
            for k, *run in zip(*(batch.column(c).to_pylist() for c in ("range", "digest", "_key", "start")), strict=True):
                if k != at:
                    yield from close()
                    at = k
                held.append(run)
        yield from close()

    parts = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = windows.select("digest", "_key", "start").mapInArrow(cut, "range int, digest binary, _key binary, start binary")
    return runs.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(merge, "_key long, start long")


def _cut_texts(rows: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept, digest = [], [], [], []
            for text, ranges in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for start, stop in sorted({(r["start"], r["stop"]) for r in ranges}):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], stop)
                    else:
                        merged.append([start, stop])
                rest, at = [], 0
                for start, stop in merged:
                    rest.append(text[at:start])
                    at = stop
                rest = b"".join([*rest, text[at:]])
                removed.append(len(text) - len(rest))
                spans.append([{"start": a, "stop": b} for a, b in merged])
                digest.append(hashlib.sha256(rest).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(digest, pa.string())], names=["_key", "removed", "spans", "sha"])

    return rows.select("_key", "text", "ranges").mapInArrow(cut, "_key long, removed long, spans array<struct<start:bigint,stop:bigint>>, sha string")


def report(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (ranges of bytes removed) of every row."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    anchors = written(_anchors(keyed.select("_key", "text")), "anchors")
    many = anchors.groupBy("anchor").agg(F.count("*").alias("many")).where("many > 1")
    marks = skew_join(anchors, many, "anchor").groupBy("_key").agg(F.collect_list(F.struct("first", "number", "anchor", "many")).alias("marks"))
    marks = checkpointed(marks)
    some = maybe_in(keyed.select("_key", "text"), marks.select(F.col("_key").alias("_mark")), "_key", "_mark").join(marks, "_key")
    some = written(some, "marked")
    found = checkpointed(_search(_pieces(some, hot)))
    across = _across(found.where("digest <> 0"))
    ranges = found.where("digest = 0").select("_key", "start", "stop").union(across.select("_key", "start", (F.col("start") + MATCH).alias("stop")))
    ranges = ranges.groupBy("_key").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    cut = _cut_texts(some.select("_key", "text").join(ranges, "_key"))
    cut = checkpointed(cut.dropDuplicates(["_key"]))
    base = keyed.select("doc_id", "_key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text"), 256).alias("_whole"))
    rows = base.join(cut, "_key", "left")
    return rows.select(
        "doc_id", "n_bytes", F.coalesce("removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", "_whole").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"),
    )
