"""Helpers the operators share: shared folders, joins on hot keys, groups of linked rows, words as numbers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
#: The same as a character class, and a word.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Texts of a batch that are worked on at once.
SLICE_BYTES = 2 << 20
#: Rows and bytes of an Arrow batch that goes to a Python worker, whichever comes first.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
#: Bits of a bitmap of ``bitmap_construct_agg``, and of all that a filter by bitmaps has.
_MAP_BITS = 1 << 15
_MOST_BITS = 1 << 27
#: Powers kept for the next call of a worker, 16 bytes each.
_KEPT_POWERS = 1 << 22

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets one of its own; a cluster
    is refused, since its machines would write to folders of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared checkpoint folder; a lost executor loses none of them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a compressed table in the shared folder, for results with texts."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """An equality join in which a hot key may hold a third of all rows of ``left``.

    Adaptive execution splits a hot partition of a sort-merge join only if both
    sides were shuffled for that join. A second key that follows from the first
    keeps Spark from reusing the partitioning of an earlier aggregation.
    """
    second = F.pmod(F.xxhash64(key), F.lit(2))
    both = left.withColumn("_second", second).join(right.withColumn("_second", second), [key, "_second"], how)
    return both.drop("_second")


def maybe_in(rows: DataFrame, keys: DataFrame, key: str, other: str, bits: int = 1 << 27, keep: bool = True) -> DataFrame:
    """``rows`` whose ``key`` may be among ``keys`` by a Bloom filter of one hash, or the rest (``keep=False``).

    It saves a join from shuffling rows that it would not change. Its 64-bit words are
    broadcast, at most ``bits / 64`` of them (2**21 rows of 16 bytes), whatever the input.
    """
    return _by_words(rows, _bloom_words(keys, other, bits), key, bits, keep)


def maybe_split(rows: DataFrame, keys: DataFrame, key: str, other: str) -> tuple[DataFrame, DataFrame]:
    """Both parts of ``maybe_in`` by the same bitmaps; a plan that holds both broadcasts them once.

    There are 16 bits for each key up to ``_MOST_BITS`` in all, in bitmaps of 4 KB: 2 bytes a key, and 16 MB at
    most, are gathered on the driver, where rows of 64 bits take some 80 bytes each.
    """
    bits = min(max(1 << (16 * keys.count()).bit_length(), _MAP_BITS), _MOST_BITS)
    place = lambda name: F.pmod(F.xxhash64(name), F.lit(bits))
    number = lambda name: F.floor(place(name) / _MAP_BITS).cast("long").alias("_map")
    maps = keys.groupBy(number(other)).agg(F.bitmap_construct_agg(F.pmod(place(other), F.lit(_MAP_BITS))).alias("_bits"))
    maps = F.broadcast(checkpointed(maps).where("_map IS NOT NULL AND _bits IS NOT NULL"))  # which else only the inner join asks
    at = F.pmod(place(key), F.lit(_MAP_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.getbit(byte, F.pmod(at, F.lit(8))) == 1
    placed = rows.withColumn("_map", number(key))
    kept, rest = placed.join(maps, "_map").where(found), placed.join(maps, "_map", "left").where(~F.coalesce(found, F.lit(False)))
    return kept.select(*rows.columns), rest.select(*rows.columns)


def _bloom_words(keys: DataFrame, other: str, bits: int) -> DataFrame:
    at = F.pmod(F.xxhash64(other), F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    return checkpointed(keys.groupBy(F.floor(at / 64).cast("long").alias("_word")).agg(F.bit_or(bit).alias("_bits")))


def _by_words(rows: DataFrame, words: DataFrame, key: str, bits: int, keep: bool) -> DataFrame:
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    placed = rows.withColumn("_word", F.floor(place / 64).cast("long"))
    found = F.getbit("_bits", F.pmod(place, F.lit(64)).cast("int")) == 1
    words = F.broadcast(words)
    kept = placed.join(words, "_word").where(found) if keep else placed.join(words, "_word", "left").where(~F.coalesce(found, F.lit(False)))
    return kept.select(*rows.columns)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long) as rows ``node, component``, the smallest node of each.

    Large-star and small-star rounds, in which every round is an aggregation
    (combined on the map side) and a join that adaptive execution can split.
    Nodes without an edge to another node are not returned.
    """
    e = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct()
    e = checkpointed(e)
    before = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = skew_join(both.where("v > u"), low, "u").select("v", F.col("m").alias("u")).where("v <> u").distinct()
        # small star: v keeps its larger neighbours out and joins the smallest of the others
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = skew_join(large, low, "v")
        linked = small.select(F.col("u").alias("v"), F.col("m").alias("u")).union(small.select("v", F.col("m").alias("u")))
        e = checkpointed(linked.where("v <> u").distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    nodes = e.groupBy("v").agg(F.min("u").alias("component")).select(F.col("v").alias("node"), "component")
    roots = nodes.select("component").distinct().select(F.col("component").alias("node"), "component")
    return nodes.union(roots)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of unsigned numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)  # odd, so that it has an inverse modulo 2**64


def _powers(n: int, factor: np.uint64) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    if n:
        out[0] = 1
        done = 1
        while done < n:  # doubling, each time by one product
            step = min(done, n - done)
            out[done : done + step] = out[:step] * np.uint64(pow(int(factor), done, 1 << 64))
            done += step
    return out


_CACHE: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse, kept for the next call of a worker (long ones are made anew)."""
    if n > _KEPT_POWERS:
        return _powers(n, _FACTOR), _powers(n, np.uint64(pow(int(_FACTOR), -1, 1 << 64)))
    if not _CACHE or len(_CACHE["up"]) < n:
        size = ((n >> 18) + 1) << 18
        _CACHE["up"] = _powers(size, _FACTOR)
        _CACHE["down"] = _powers(size, np.uint64(pow(int(_FACTOR), -1, 1 << 64)))
    return _CACHE["up"][:n], _CACHE["down"][:n]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column with about ``most`` bytes each (one row at least)."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)
    pa.default_memory_pool().release_unused()  # idle workers would hold what the last stage has freed


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row begins (one entry more than rows); null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit number for each word of each row, and the row of each word, in text order."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if lower:
        data = _LOWER[data]
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts_rows = offsets[:-1][offsets[:-1] < len(data)]
    first[starts_rows] = inside[starts_rows]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_VALUES[data] * up[:-1], out=total[1:])
    hashes = mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * _GOLDEN)
    return hashes, np.searchsorted(offsets, begin, side="right") - 1


def no_spaces(text: Column) -> Column:
    """The text without the characters of ``SPACES``; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package as a zip file, once a session; they need not have it installed.

    Rows are whole texts or packed arrays, so Arrow batches are held to ``BATCH_ROWS`` of them and
    ``BATCH_BYTES``, which bounds the memory of the workers and the executors' memory outside the heap.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    name = "cdcmart_llm.zip"
    if any(f.endswith(name) for f in sc.listFiles):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="llm-")) / name
    with zipfile.ZipFile(target, "w") as z:
        z.write(here.parent / "__init__.py", "cdcmart/__init__.py")
        for file in sorted(here.glob("*.py")):
            z.write(file, f"cdcmart/llm/{file.name}")
    sc.addPyFile(str(target))
