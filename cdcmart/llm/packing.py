"""Packing tokens into windows: bounded-space online best fit.

Each partition keeps ``open_windows`` windows open. A piece goes into the open
window that it leaves least room in; if it fits in none, its beginning fills the
fullest window, which is emitted, and the rest goes on. Windows still open at the
end of a partition are leftovers: groups of ``MERGE`` partitions merge theirs, and
what is left of a group is cut into powers of two, which need no padding.

Token ids come from the named tokenizer file. Runs of letters, of digits and of
other signs are tokenized once per task (its own cut of a text) and looked up
afterwards, all different ones of some MB of text at once; anything unusual goes to
the tokenizer as it is. What a task remembers is bounded in bytes and goes at its end.

Defined cases: null text is empty and has the end id alone; repeated rows are packed
once each; a piece never crosses documents; further columns are ignored. The result
hangs on how the input is split into partitions, not on the order of the tasks.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdcmart.llm.common import checkpointed, slices

WINDOW = 2048
OPEN_WINDOWS = 16
#: Partitions whose leftovers one task merges: at most MERGE * OPEN_WINDOWS windows.
MERGE = 32
END_ID = 1
#: Bytes of runs of letters or signs, and of parts between white space, that a task remembers with their ids (some 30 bytes each).
RUNS, PARTS = 12 << 20, 32 << 20
#: Bytes of text whose parts are looked up at once.
TEXTS = 4 << 20

# Latin text without number signs and free accents: lower case is the same letter by letter, no form composes.
_PLAIN = re.compile("[\t-\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u02af]*+")
_RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")

PIECE = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, window long, at long, is_open boolean, part int, ids binary"


class Memory:
    """Token ids (little-endian, 4 bytes each) of strings, in Arrow arrays; new strings are learned and remembered.

    When the strings and their ids take more than ``most`` bytes, those go that were asked for longest ago, half or more.
    """

    def __init__(self, learn: Callable[[list[str]], pa.Array], most: int) -> None:
        self.learn, self.most = learn, most
        self.strings, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())
        self.asked, self.clock = np.empty(0, np.int64), 0

    def __call__(self, strings: pa.Array) -> pa.Array:
        """Ids of each string, repeated ones included."""
        strings = strings.dictionary_encode()
        at = pc.index_in(strings.dictionary, value_set=self.strings)
        new = strings.dictionary.filter(pc.is_null(at))
        at = np.array(pc.fill_null(at, -1))
        if len(new):
            at[at < 0] = np.arange(len(self.strings), len(self.strings) + len(new))
            self.ids = pa.concat_arrays([self.ids, self.learn(new.to_pylist())])
            self.strings = pa.concat_arrays([self.strings, new])
            self.asked = np.concatenate([self.asked, np.zeros(len(new), np.int64)])
        self.clock += 1
        self.asked[at] = self.clock
        found = self.ids.take(pa.array(at)).take(strings.indices)
        if self.strings.nbytes + self.ids.nbytes > self.most:
            kept = self.asked > np.median(self.asked)
            self.strings, self.ids, self.asked = self.strings.filter(kept), self.ids.filter(kept), self.asked[kept]
        return found


def _joined(ids: pa.Array, counts: Iterable[int]) -> pa.Array:
    """Neighbours joined to one entry each, so many as ``counts`` says."""
    ends = np.concatenate([[0], np.cumsum(np.fromiter(counts, np.int64))])
    _, offsets, data = ids.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(ids) + 1, 4 * ids.offset) if len(ids) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets[ends]), data])


class Words:
    """Token ids (little-endian, 4 bytes each) of texts, remembering the parts between white space."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.runs, self.parts = Memory(self._learn_runs, RUNS), Memory(self._learn_parts, PARTS)

    def _direct(self, texts: list[str]) -> list[bytes]:
        encode = partial(self.tokenizer.encode_batch_fast, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for at in range(0, len(texts), 64) for e in encode(texts[at : at + 64])]

    def _learn_runs(self, runs: list[str]) -> pa.Array:
        groups = [runs[at : at + 1024] for at in range(0, len(runs), 1024)]
        learned = []
        for some, found in zip(groups, self._direct([" ".join(g) for g in groups]), strict=True):
            ends = np.flatnonzero(self.ends[np.frombuffer(found, "<u4")]) + 1
            if len(ends) == len(some) and 4 * ends[-1] == len(found):
                offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
                learned.append(pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(found)]))
            else:
                learned.append(pa.array(self._direct(some), pa.binary()))
        return pa.concat_arrays(learned)

    def _learn_parts(self, parts: list[str]) -> pa.Array:
        """Plain parts are put together from their runs; parts with other signs go to the tokenizer as they are."""
        plain = np.array([_PLAIN.fullmatch(p) is not None and "<|" not in p for p in parts])
        known = pa.array([], pa.binary())
        if plain.any():
            lower = [p.lower() for p, is_plain in zip(parts, plain.tolist(), strict=True) if is_plain]
            split = [[p] if p.isascii() and p.isalpha() else _RUNS.findall(p) for p in lower]
            known = _joined(self.runs(pa.array(chain.from_iterable(split), pa.string())), map(len, split))
        if plain.all():
            return known
        others = pa.array(self._direct([p for p, is_plain in zip(parts, plain.tolist(), strict=True) if not is_plain]), pa.binary())
        places = np.where(plain, np.cumsum(plain) - 1, len(known) + np.cumsum(~plain) - 1)
        return pa.concat_arrays([known, others]).take(pa.array(places))

    def __call__(self, texts: list[str]) -> list[bytes]:
        lower = [t.lower() if _PLAIN.fullmatch(t) else t for t in texts]
        cut = pc.ascii_split_whitespace(pa.array(lower, pa.string()))
        found = _joined(self.parts(cut.flatten()), np.diff(np.asarray(cut.offsets))).to_pylist()
        pa.default_memory_pool().release_unused()  # else the workers of an executor hold several times what they use
        return found


_WORDS: dict[str, Words] = {}


def tokenized(path: str, texts: list[str]) -> list[bytes]:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path](texts)


def forget(path: str) -> None:
    """Leave a worker that other stages use next with the tokenizer alone."""
    if path in _WORDS:
        _WORDS[path].forget()
        pa.default_memory_pool().release_unused()


class Packer:
    """Open windows of one partition; a piece is (document, start, its ids, tokens of the document)."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> None:
        self.window, self.most = window, open_windows
        self.by_room: list[tuple[int, int]] = []  # room left, window number
        self.pieces: dict[int, list[tuple]] = {}
        self.used: dict[int, int] = {}
        self.number = 0

    def _open(self) -> int:
        self.number += 1
        self.pieces[self.number], self.used[self.number] = [], 0
        return self.number

    def _put(self, window: int, piece: tuple) -> None:
        self.pieces[window].append((*piece, self.used[window]))
        self.used[window] += len(piece[2]) // 4

    def add(self, doc, ids: bytes, start: int = 0, tokens: int | None = None) -> Iterator[tuple[int, list[tuple]]]:
        """Place a document's ids; yields windows that are full."""
        at, end = 0, len(ids) // 4
        tokens = end if tokens is None else tokens
        while end - at >= self.window:  # whole windows of its own
            own = self._open()
            self._put(own, (doc, start + at, ids[4 * at : 4 * (at + self.window)], tokens))
            at += self.window
            yield self._close(own)
        while at < end:
            need = end - at
            fit = bisect_left(self.by_room, (need, -1))
            if fit < len(self.by_room):
                room, window = self.by_room.pop(fit)
            elif len(self.by_room) < self.most:
                room, window = self.window, self._open()
            else:
                room, window = self.by_room.pop(0)  # the fullest: filled by the beginning of the piece
            taken = min(need, room)
            self._put(window, (doc, start + at, ids[4 * at : 4 * (at + taken)], tokens))
            at += taken
            if taken == room:
                yield self._close(window)
            else:
                insort(self.by_room, (room - taken, window))

    def _close(self, window: int) -> tuple[int, list[tuple]]:
        del self.used[window]
        return window, self.pieces.pop(window)

    def rest(self) -> Iterator[tuple[int, list[tuple]]]:
        for _, window in self.by_room:
            yield self._close(window)
        self.by_room = []


def _rows(windows: Iterator[tuple[int, list[tuple]]], is_open: bool, part: int) -> Iterator[tuple]:
    for window, pieces in windows:
        for doc, start, ids, tokens, at in pieces:
            yield doc, start, len(ids) // 4, zlib.crc32(ids), tokens, window, at, is_open, part, ids if is_open else None


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "at", "is_open", "part", "ids"]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, small ones put together to ``TEXTS`` bytes or more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= TEXTS:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _merge(window: int, most: int):
    """Leftover windows of a group of partitions, packed again; the end is cut into powers of two."""

    def merge(key: tuple, pieces: pa.Table) -> pa.Table:
        packer = Packer(window, 1)
        pieces = pieces.sort_by([("part", "ascending"), ("window", "ascending"), ("at", "ascending")])
        group, done = key[0].as_py(), []
        for row in pieces.to_pylist():
            done += packer.add(row["doc_id"], row["ids"], row["start"], row["doc_tokens"])
        out = list(_rows(iter(done), False, group))
        number = packer.number
        for _, last in packer.rest():
            left = sum(len(p[2]) for p in last) // 4
            sizes = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
            todo = [(p[0], p[1], p[2], p[3]) for p in last]
            for size in sizes:
                number += 1
                at = 0
                while at < size:
                    doc, start, ids, tokens = todo.pop(0)
                    taken = min(size - at, len(ids) // 4)
                    out += _rows(iter([(number, [(doc, start, ids[: 4 * taken], tokens, at)])]), False, group)
                    if 4 * taken < len(ids):
                        todo.insert(0, (doc, start + taken, ids[4 * taken :], tokens))
                    at += taken
        return pa.Table.from_batches([_batch(out, pieces.schema.field("doc_id").type)])

    return merge


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece."""
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    end = np.array([end_id], "<u4").tobytes()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, part, kind = Packer(window, open_windows), TaskContext.get().partitionId(), None
        for batch in _gathered(batches):
            ids_of, texts = batch.column("doc_id"), batch.column("text")
            kind = ids_of.type
            for start, stop in slices(texts, TEXTS):
                some = texts.slice(start, stop - start).fill_null("").to_pylist()
                done = []
                for doc, ids in zip(ids_of.slice(start, stop - start).to_pylist(), tokenized(tokenizer_path, some), strict=True):
                    done += packer.add(doc, ids + end)
                if done:
                    yield _batch(list(_rows(iter(done), False, part)), kind)
        if kind is not None:
            yield _batch(list(_rows(packer.rest(), True, part)), kind)
        forget(tokenizer_path)

    schema = PIECE.format(kind=docs.schema["doc_id"].dataType.simpleString())
    placed = checkpointed(docs.select("doc_id", "text").mapInArrow(place, schema))
    leftovers = placed.where("is_open").withColumn("_group", F.floor(F.col("part") / MERGE).cast("int"))
    merged = leftovers.groupBy("_group").applyInArrow(_merge(window, open_windows), schema)
    # window numbers count from one in each partition and in each group
    first = placed.where("NOT is_open").withColumn("sequence_id", F.col("part").cast("long") * (1 << 32) + F.col("window"))
    second = merged.withColumn("sequence_id", (F.col("part").cast("long") + (1 << 30)) * (1 << 32) + F.col("window"))
    rows = first.unionByName(second)
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.col("at").alias("offset"))
