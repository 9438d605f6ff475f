"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Two documents link when the Jaccard similarity of their sets of word shingles is at
least ``share`` (in hundredths). Sets are sorted arrays of 64-bit shingle hashes.

1. *Who may link.* In hash order, linked sets share at least ``l`` of their first
   ``n - T + l`` shingles (T: the overlap they need). With ``l = n / 5`` a document can
   link only if half of its first two fifths occur elsewhere. Each slice of documents
   sends every such shingle once, packed by hash bucket, so a shingle that a third of
   all documents hold is as light as any other.
2. *Classes.* Equal sets are one class; its smallest doc_id stands for it.
3. *Where they can meet.* Shingles of the classes left are ordered by how many classes
   hold them, rarest first. Linked sets share one of their first ``n - T + 1``; classes
   that meet there, directly or through others, form a cluster.
4. *Search.* A cluster is cut into blocks by size of set and hash; only blocks whose
   sizes can link meet. In a pair of blocks every set is searched in the inverted lists
   of the other: its short lists are merged, candidates seen ``T - L`` times are probed
   by binary search in the ``L`` long lists, and those reaching ``T`` are links. A task
   returns links that connect something new to it, and how many links each class has.
5. Components of those links.

Nothing is sampled or capped, and no hash decides alone: equality of shingles is
equality of 64-bit hashes.

Defined cases: null text is empty; a document without words has no shingle, no link and
is its own component; rows without doc_id take no part (component null); rows with the
same doc_id are one document, which links all its texts; further columns are ignored by
``report`` and kept by ``representatives``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdcmart.llm.common import checkpointed, components, maybe_in, mixed, skew_join, slices, text_bytes, word_hashes, written

SHINGLE = 5
SHARE = 80
#: Sets of a block.
BLOCK = 256
#: Rows of a slice stay below the numbers of two bytes; the last stands for "no document here".
_SLICE_ROWS = 60_000
_NONE = 0xFFFF
#: DivideSkip's weight of a probe against a step of the merge.
MU = 0.01

_PLACES = mixed(np.arange(11, 11 + 64, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    hashes, row = word_hashes(data, offsets)
    rows = len(offsets) - 1
    bounds = np.searchsorted(row, np.arange(rows + 1))
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += hashes[j : j + n] * _PLACES[j]
    whole = mixed(total)
    out = []
    for r in range(rows):
        lo, hi = bounds[r], bounds[r + 1]
        if hi - lo >= size:
            values = np.sort(whole[lo : hi - size + 1])
            out.append(values[np.concatenate([[True], values[1:] != values[:-1]])])
        elif hi > lo:
            some = (hashes[lo:hi] * _PLACES[: hi - lo]).sum(dtype=np.uint64, keepdims=True) + _PLACES[size + hi - lo]
            out.append(mixed(some))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def least_overlap(n, share: int = SHARE):
    """Shingles that a set of ``n`` must share with any partner, however small."""
    return -(-n * share // 100)


def needed(n, m, share: int = SHARE):
    """Overlap at which sets of ``n`` and ``m`` link: share (n + m) / (100 + share), rounded up."""
    return -(-(n + m) * share // (100 + share))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    for start, stop in slices(batch.column("text")):
        for at in range(start, stop, _SLICE_ROWS):
            yield at, min(at + _SLICE_ROWS, stop)


def _profiles(docs: DataFrame) -> DataFrame:
    """``doc_id, n, set_id``: set size, and 16 bytes that tell sets apart."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _slices(batch):
                sets = shingle_sets(*text_bytes(batch.column("text").slice(start, stop - start)))
                ids = [np.array([s.sum(dtype=np.uint64), mixed(s ^ _PLACES[60]).sum(dtype=np.uint64)]).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "n", "set_id"],
                )

    return docs.mapInArrow(profile, "doc_id long, n long, set_id binary")


def _may_link(docs: DataFrame, share: int) -> DataFrame:
    """``doc_id, found, wanted``: how many of a document's first shingles occur elsewhere, and how many must."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(6, (parts - 1).bit_length())

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _slices(batch):
                ids = np.asarray(batch.column("doc_id").slice(start, stop - start))
                sets = shingle_sets(*text_bytes(batch.column("text").slice(start, stop - start)))
                values, doc, asks = [], [], []
                for i, s in enumerate(sets):
                    n = len(s)
                    if n:
                        rest = n - least_overlap(n, share)
                        posted = min(n, rest + max(1, -(-n * (100 - share) // share)))
                        values.append(s[:posted])
                        doc.append(np.full(posted, i))
                        asks.append(np.arange(posted) < rest + max(1, n * (100 - share) // 100))
                if not values:
                    continue
                values, doc, asks = np.concatenate(values), np.concatenate(doc), np.concatenate(asks)
                order = np.argsort(values, kind="stable")
                values, doc, asks = values[order], doc[order], asks[order]
                first = np.concatenate([[True], values[1:] != values[:-1]])
                group = np.cumsum(first) - 1
                alone = np.bincount(group) == 1
                here = np.bincount(doc[asks & ~alone[group]], minlength=len(sets))  # occurs twice in this slice
                yield _found(ids, here)
                heads = np.flatnonzero(first)
                who = np.where(alone & asks[heads], doc[heads], _NONE)
                bucket = (values[heads] & np.uint64((1 << bits) - 1)).astype(np.int64)
                short = (values[heads] >> np.uint64(bits)).astype(np.uint32)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
                out = [[], [], [], []]
                for b in range(1 << bits):
                    mine = order[cuts[b] : cuts[b + 1]]
                    if len(mine):
                        seen = np.unique(who[mine])
                        out[0].append(b)
                        out[1].append(short[mine].tobytes())
                        out[2].append(np.where(who[mine] == _NONE, _NONE, np.searchsorted(seen, who[mine])).astype(np.uint16).tobytes())
                        out[3].append(ids[seen[seen != _NONE]].tobytes())
                yield _posting(*out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket, ids, many = [], None, [], 0

        def close() -> None:
            nonlocal many
            if len(held) > 1:
                values = np.concatenate([h[0] for h in held])
                who = np.concatenate([h[1] for h in held])
                at = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
                order = np.argsort(values, kind="stable")
                same = values[order][1:] == values[order][:-1]
                shared = np.zeros(len(values), bool)
                shared[order[1:]] |= same
                shared[order[:-1]] |= same
                shared &= who != _NONE
                for k in np.unique(at[shared]).tolist():
                    ids.append(held[k][2][who[shared & (at == k)]])
                    many += len(ids[-1])
            held.clear()

        for batch in batches:
            for b, values, who, docs_of in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if b < 0:  # counts of a slice
                    ids.append(np.repeat(np.frombuffer(docs_of, np.int64), np.frombuffer(values, np.int64)))
                    many += len(ids[-1])
                else:
                    if b != bucket:
                        close()
                        bucket = b
                    held.append((np.frombuffer(values, np.uint32), np.frombuffer(who, np.uint16), np.frombuffer(docs_of, np.int64)))
                if many > 4_000_000:
                    yield _counted(ids)
                    ids, many = [], 0
        close()
        yield _counted(ids)

    known = docs.where("doc_id IS NOT NULL")
    packed = known.mapInArrow(post, "bucket int, hashes binary, who binary, ids binary")
    dealt = packed.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(count, "doc_id long, found long").groupBy("doc_id").agg(F.sum("found").alias("found"))


def _posting(bucket: list, hashes: list, who: list, ids: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(hashes, pa.binary()), pa.array(who, pa.binary()), pa.array(ids, pa.binary())],
        names=["bucket", "hashes", "who", "ids"],
    )


def _found(ids: np.ndarray, here: np.ndarray) -> pa.RecordBatch:
    some = here > 0  # goes to a partition of its own slice, by a negative number
    at = -1 - int(ids[0]) % 4096 if len(ids) else -1
    return _posting([at], [here[some].astype(np.int64).tobytes()], [b""], [ids[some].astype(np.int64).tobytes()])


def _counted(ids: list[np.ndarray]) -> pa.RecordBatch:
    doc, n = np.unique(np.concatenate(ids), return_counts=True) if ids else (np.empty(0, np.int64), np.empty(0, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "found"])


def _class_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Slices of sets: ``slice, reps, sizes, members, values`` as packed arrays."""
    reps = classes.select(F.col("rep").alias("_rep"), "members")
    chosen = maybe_in(docs.select("doc_id", "text"), reps, "doc_id", "_rep").join(reps, F.col("doc_id") == F.col("_rep"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, stop in _slices(batch):
                part = batch.slice(start, stop - start)
                sets = shingle_sets(*text_bytes(part.column("text")))
                number += 1
                packed = [np.asarray(part.column("doc_id")), np.array([len(s) for s in sets], np.int64), np.asarray(part.column("members"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), *(pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in packed), pa.array([np.concatenate(sets).tobytes()], pa.binary())],
                    names=["slice", "reps", "sizes", "members", "values"],
                )

    sliced = chosen.select("doc_id", "text", "members").mapInArrow(pack, "slice long, reps binary, sizes binary, members binary, values binary")
    return written(sliced, "sets")


def _meetings(sets: DataFrame, share: int) -> DataFrame:
    """``shingle, rep``: the rarest shingles of each class, of which linked classes have one in common."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(6, (parts - 1).bit_length())

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, values in zip(batch.column("slice").to_pylist(), batch.column("values").to_pylist(), strict=True):
                distinct, n = np.unique(np.frombuffer(values, np.uint64), return_counts=True)
                bucket = distinct & np.uint64((1 << bits) - 1)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
                mine = [order[cuts[b] : cuts[b + 1]] for b in range(1 << bits)]
                some = [b for b in range(1 << bits) if len(mine[b])]
                yield _frequency(some, [number] * len(some), [distinct[mine[b]] for b in some], [n[mine[b]] for b in some])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                values = np.concatenate([h[1] for h in held])
                distinct, at = np.unique(values, return_inverse=True)
                total = np.bincount(at, weights=np.concatenate([h[2] for h in held])).astype(np.int64)
                cuts = np.cumsum([0] + [len(h[1]) for h in held])
                shared = [at[a:b][total[at[a:b]] > 1] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield _frequency([bucket] * len(held), [h[0] for h in held], [distinct[s] for s in shared], [total[s] for s in shared])
                held.clear()

        for batch in batches:
            for b, number, values, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if b != bucket:
                    yield from close()
                    bucket = b
                held.append((number, np.frombuffer(values, np.uint64), np.frombuffer(n, np.uint32)))
        yield from close()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_of, own, known = None, None, []

        def close() -> Iterator[pa.RecordBatch]:
            if own is None:
                return
            values = np.concatenate([k[0] for k in known]) if known else np.empty(0, np.uint64)
            total = np.concatenate([k[1] for k in known]) if known else np.empty(0, np.uint32)
            order = np.argsort(values)
            values, total = values[order], total[order]
            reps, sizes, sets = own
            shingles, of = [], []
            for rep, s in zip(reps.tolist(), np.split(sets, np.cumsum(sizes)[:-1]), strict=True):
                at = np.searchsorted(values, s)
                at[at == len(values)] = 0
                hit = values[at] == s if len(values) else np.zeros(len(s), bool)
                left = len(s) - least_overlap(len(s), share) + 1 - int((~hit).sum())  # the rarest come first and meet nobody
                if left > 0:
                    mine = s[hit]
                    some = mine[np.lexsort((mine, total[at[hit]]))[:left]]
                    shingles.append(some.view(np.int64))
                    of.append(np.full(len(some), rep))
            if of:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingles)), pa.array(np.concatenate(of))], names=["shingle", "rep"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["slice"] != slice_of:
                    yield from close()
                    slice_of, own, known = row["slice"], None, []
                if row["reps"] is not None:
                    own = tuple(np.frombuffer(row[k], np.uint64 if k == "values" else np.int64) for k in ("reps", "sizes", "values"))
                else:
                    known.append((np.frombuffer(row["values"], np.uint64), np.frombuffer(row["n"], np.uint32)))
        yield from close()

    posted = sets.select("slice", "values").mapInArrow(post, "bucket int, slice long, values binary, n binary")
    counted = posted.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(add, "bucket int, slice long, values binary, n binary")
    nothing = F.lit(None).cast("binary")
    both = sets.select("slice", "reps", "sizes", "values", nothing.alias("n")).unionByName(
        counted.select("slice", nothing.alias("reps"), nothing.alias("sizes"), "values", "n")
    )
    return both.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(choose, "shingle long, rep long")


def _frequency(bucket: list, number: list, values: list, n: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(number, pa.int64()), pa.array([v.tobytes() for v in values], pa.binary()), pa.array([x.astype(np.uint32).tobytes() for x in n], pa.binary())],
        names=["bucket", "slice", "values", "n"],
    )


def divide_skip(query: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray], sizes: np.ndarray, share: int = SHARE) -> np.ndarray:
    """Numbers of the sets that link with ``query``, by its inverted lists (distinct shingles, where each list begins, all members)."""
    shingles, begin, members = lists
    n = len(query)
    at = np.searchsorted(shingles, query)
    at[at == len(shingles)] = 0
    at = at[shingles[at] == query]
    least = int(least_overlap(n, share))
    if len(at) < least or not least:
        return np.empty(0, np.int64)
    length = begin[at + 1] - begin[at]
    order = np.argsort(length, kind="stable")
    at, length = at[order], length[order]
    long = min(least - 1, int(least / (MU * math.log2(int(length[-1]) + 1) + 1)))
    short = at[: len(at) - long]
    merged = np.sort(np.concatenate([members[begin[a] : begin[a + 1]] for a in short.tolist()]))
    candidates, seen = np.unique(merged, return_counts=True)
    wanted = needed(n, sizes[candidates], share)
    for k, a in enumerate(at[len(at) - long :].tolist()):
        stays = seen + (long - k) >= wanted
        if not stays.all():
            candidates, seen, wanted = candidates[stays], seen[stays], wanted[stays]
        if not len(candidates):
            return candidates
        some = members[begin[a] : begin[a + 1]]
        place = np.searchsorted(some, candidates)
        place[place == len(some)] = 0
        seen = seen + (some[place] == candidates)
    return candidates[seen >= wanted]


def inverted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    shingles, begin = np.unique(values[order], return_index=True)
    return shingles, np.append(begin, len(values)), owner[order]


def _links(groups: DataFrame, share: int) -> DataFrame:
    """``a, b, links``: links that connect, and how many documents each class of a pair of blocks links with."""

    def search(held: list[tuple]) -> Iterator[tuple]:
        own = [h for h in held if h[0] == 2]  # a block with itself
        left, right = (own, own) if own else ([h for h in held if h[0] == 0], [h for h in held if h[0] == 1])
        if not left or not right:
            return
        sets = [np.frombuffer(h[4], np.uint64) for h in right]
        sizes, members = np.array([len(s) for s in sets]), np.array([h[3] for h in right])
        lists = inverted(sets)
        root = {h[2]: h[2] for h in left + right}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        links: dict[int, int] = {}
        for i, (_, _, rep, weight, values) in enumerate(left):
            for j in divide_skip(np.frombuffer(values, np.uint64), lists, sizes, share).tolist():
                other = right[j][2]
                if right is left and j <= i:
                    continue
                links[rep] = links.get(rep, 0) + int(members[j])
                links[other] = links.get(other, 0) + weight
                a, b = find(rep), find(other)
                if a != b:
                    root[a] = b
                    yield rep, other, 0
        for rep, n in links.items():
            yield rep, None, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("pair", "side", "rep", "members", "shingles")), strict=True):
                if row[0] != key:
                    if len(held) > 1:
                        out += search(held)
                    key, held = row[0], []
                held.append((row[1], row[0], row[2], row[3], row[4]))
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        if len(held) > 1:
            out += search(held)
        yield _edges(out)

    return groups.mapInArrow(run, "a long, b long, links long")


def _edges(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "links"])


def _blocks(sets: DataFrame, clusters: DataFrame, share: int) -> DataFrame:
    """Each set once for each pair of blocks it belongs to, pairs side by side in the partitions."""
    base = math.log(100 / share)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reps, sizes, members = (np.frombuffer(row[k], np.int64) for k in ("reps", "sizes", "members"))
                sets = np.split(np.frombuffer(row["values"], np.uint64), np.cumsum(sizes)[:-1])
                band = np.floor(np.log(np.maximum(sizes, 1)) / base).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reps), pa.array(band), pa.array(members), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "band", "members", "shingles"]
                )

    rows = sets.mapInArrow(unpack, "rep long, band long, members long, shingles binary").join(clusters.withColumnRenamed("node", "rep"), "rep")
    # a set can link within its band of sizes and with the bands next to it
    counts = clusters.withColumnRenamed("node", "rep").join(
        sets.select("reps", "sizes").mapInArrow(_bands(base), "rep long, band long"), "rep"
    ).groupBy("component", "band").agg(F.count("*").alias("many"))
    counts = counts.withColumn("blocks", F.ceil(F.col("many") / BLOCK)).select("component", "band", "blocks")
    counts = checkpointed(counts)
    above = counts.select("component", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = counts.select("component", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    around = counts.join(above, ["component", "band"], "left").join(below, ["component", "band"], "left").na.fill(0, ["above", "below"])
    rows = rows.withColumn("_at", F.xxhash64("component", "band"))
    around = around.withColumn("_at", F.xxhash64("component", "band")).drop("component", "band")
    rows = skew_join(rows, around, "_at")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")))
    pair = lambda band, side, mine, other: F.struct(band.alias("band"), side.alias("side"), mine.alias("i"), other.alias("j"))
    within = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda k: pair(F.col("band") * 2, F.when(k == F.col("block"), 2).when(k > F.col("block"), 0).otherwise(1), F.least(k, "block"), F.greatest(k, "block")),
    )
    up = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest("above", F.lit(1).cast("long"))), lambda k: pair(F.col("band") * 2 + 1, F.lit(0), F.col("block"), k - 1))
    down = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest("below", F.lit(1).cast("long"))), lambda k: pair(F.col("band") * 2 - 1, F.lit(1), k - 1, F.col("block")))
    pairs = F.concat(within, F.when(F.col("above") > 0, up).otherwise(F.slice(up, 1, 0)), F.when(F.col("below") > 0, down).otherwise(F.slice(down, 1, 0)))
    spread = rows.select("component", "rep", "members", "shingles", F.explode(pairs).alias("p"))
    spread = spread.select(F.xxhash64("component", "p.band", "p.i", "p.j").alias("pair"), F.col("p.side").alias("side"), "rep", "members", "shingles")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(parts, "pair").sortWithinPartitions("pair", "side", "rep")


def _bands(base: float):
    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for reps, sizes in zip(batch.column("reps").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                n = np.maximum(np.frombuffer(sizes, np.int64), 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(reps, np.int64)), pa.array(np.floor(np.log(n) / base).astype(np.int64))], names=["rep", "band"])

    return bands


def report(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profiles = checkpointed(_profiles(docs))
    found = _may_link(docs, share)
    wanted = F.greatest(F.lit(1), F.floor(F.col("n") * (100 - share) / 100))
    chosen = profiles.join(found, "doc_id").where((F.col("n") > 0) & (F.col("found") >= wanted))
    classes = chosen.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"))
    classes = checkpointed(classes)
    sets = _class_sets(docs, classes)
    meetings = checkpointed(_meetings(sets, share))
    first = meetings.groupBy("shingle").agg(F.min("rep").alias("first"), F.count("*").alias("n")).where("n > 1")
    edges = skew_join(meetings, first, "shingle").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    clusters = components(edges)
    found = checkpointed(_links(_blocks(sets, clusters, share), share))
    linked = components(found.where("b IS NOT NULL").select("a", "b"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    known = (
        classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
        .select("set_id", F.coalesce("component", "rep").alias("_component"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("_links"))
    )
    rows = skew_join(profiles, checkpointed(known), "set_id", "left")
    linked_row = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(linked_row, F.coalesce("_component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linked_row, F.coalesce("_links", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias("n_links"),
    )


def representatives(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component, with all their columns."""
    dropped = report(docs, share).where("component_id <> doc_id").select(F.col("doc_id").alias("_dropped")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return rows.join(checkpointed(dropped), F.col("_row.doc_id") == F.col("_dropped"), "left_anti").select("_row.*")
