"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by path.

Around every hint of a licence, windows of each template's length in terms slide over the
words and are compared to that template, whatever the lines: vectors of terms weighted by
``log(1 + n / df)``, with document frequencies over all files of the templates' terms (a
broadcast list) and of every other term near a hint (joined to the files with hints). The best
window at ``LEAST`` or more gives a file its own licence (``header``); a file of which licence
windows make up at least ``FILE_SHARE`` is a licence file for its directory (``file``). Files
without a licence of their own take that of the nearest ancestor directory that has a
licence file (``inherited``): each file asks for all directories above it in one join.

Defined cases: null text is empty; a null path has no directory and inherits nothing; of
several licences in a directory the best score counts, then the name; files repeated are
scored alike; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cdcmart.llm.common import checkpointed, maybe_in, skew_join

LEAST = 0.5
FILE_SHARE = 0.2

# fixed values: notices by which licences are known
TEMPLATES = {
    "Apache-2.0": ("licensed under the apache license, version 2.0", "you may not use this file except in compliance with the apache license version 2.0"),
    "MIT": ("released under the mit license", "licensed under the mit license", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "BSD-3-Clause": ("redistribution and use in source and binary forms, with or without modification, are permitted", "licensed under the bsd 3-clause license"),
    "GPL-3.0": ("this work is licensed under the gnu general public license, version 3", "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license"),
    "LGPL-3.0": ("licensed under the gnu lesser general public license, version 3",),
    "AGPL-3.0": ("licensed under the gnu affero general public license, version 3",),
    "MPL-2.0": ("this source code form is subject to the terms of the mozilla public license, v. 2.0", "licensed under the mozilla public license, version 2.0"),
    "CC-BY-4.0": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    "CC-BY-SA-4.0": ("licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"),
    "CC-BY-NC-4.0": ("licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"),
    "Unlicense": ("this is free and unencumbered software released into the public domain",),
}

_TERM = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)?")
_NOTICES = [(name, Counter(_TERM.findall(text))) for name, texts in TEMPLATES.items() for text in texts]
_VOCABULARY = sorted({t for _, terms in _NOTICES for t in terms})
# a line that has none of these shares no weighty term with any template
_HINT = re.compile(r"licen[cs]e|permission|redistribut|public domain|creative commons|\bcc by", re.I)


_LONGEST = max(sum(terms.values()) for _, terms in _NOTICES)


def _near(text: str) -> tuple[list[re.Match], list[tuple[int, int]]]:
    """The terms of a text, and the ranges of those that a window around a hint may hold (merged)."""
    hints = [m.span() for m in _HINT.finditer(text)]
    terms = list(_TERM.finditer(text.lower())) if hints else []
    starts = [m.start() for m in terms]
    ranges: list[tuple[int, int]] = []
    for begin, end in hints:
        first = max(0, bisect_left(starts, begin + 1) - 1)
        low, high = max(0, first - _LONGEST), min(len(terms), bisect_left(starts, end) + _LONGEST)
        if ranges and low <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], high)
        else:
            ranges.append((low, high))
    return terms, ranges


def near_terms(files: DataFrame) -> DataFrame:
    """``_key, terms`` of each file with a hint: the different terms around its hints."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for key, text in zip(batch.column("_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                terms, ranges = _near(text or "")
                if ranges:
                    keys.append(key)
                    found.append(sorted({terms[i][0] for low, high in ranges for i in range(low, high)}))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.string()))], names=["_key", "terms"])

    return checkpointed(files.select("_key", "text").mapInArrow(read, "_key long, terms array<string>").dropDuplicates(["_key"]))


def frequencies(files: DataFrame) -> DataFrame:
    """``term, df``: the number of files that have each term, a grouped count over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column("text").to_pylist():
                found.update(set(_TERM.findall(text.lower())) if text else ())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "df"])

    return files.select("text").mapInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Scorer:
    """Cosine of windows of terms to each notice."""

    def __init__(self, files: int, df: dict[str, int]) -> None:
        self.files = files
        self.weight = {t: math.log(1 + files / max(1, df.get(t, 0))) for t in _VOCABULARY}
        self.notices = []
        for name, terms in _NOTICES:
            vector = {t: n * self.weight[t] for t, n in terms.items()}
            self.notices.append((name, sum(terms.values()), vector, math.sqrt(sum(x * x for x in vector.values()))))

    def windows(self, terms: list[str], weight: dict[str, float]) -> Iterator[tuple[int, int, str, float]]:
        """First and end of each window, the notice of its length, and the cosine, from ``LEAST`` on; sums are carried from window to window."""
        for name, length, notice, norm in self.notices:
            counts: Counter = Counter()
            square = dot = 0.0
            length = min(length, len(terms))
            for i, term in enumerate(terms):
                w = weight[term]
                square += (2 * counts[term] + 1) * w * w
                dot += notice.get(term, 0.0) * w
                counts[term] += 1
                if i >= length:
                    old = terms[i - length]
                    w = weight[old]
                    square -= (2 * counts[old] - 1) * w * w
                    dot -= notice.get(old, 0.0) * w
                    counts[old] -= 1
                if i >= length - 1 and norm and square > 1e-12:
                    score = dot / (math.sqrt(square) * norm)
                    if score >= LEAST:
                        yield i + 1 - length, i + 1, name, score

    def own(self, text: str, df: dict[str, int]) -> tuple[str | None, float, float]:
        """Licence, score, and the part of the text in windows of licences."""
        name, best, held = None, 0.0, []
        terms, ranges = _near(text)
        for low, high in ranges:
            words = [m[0] for m in terms[low:high]]
            weight = {t: self.weight[t] if t in self.weight else math.log(1 + self.files / max(1, df.get(t, 0))) for t in set(words)}
            for a, b, notice, score in self.windows(words, weight):
                held.append((terms[low + a].start(), terms[low + b - 1].end()))
                if score > best + 1e-9:
                    name, best = notice, score
        covered, end = 0, 0
        for a, b in sorted(held):
            covered += max(0, b - max(a, end))
            end = max(end, b)
        return name, min(best, 1.0), min(1.0, covered / len(text)) if text else 0.0


def own_licences(files: DataFrame) -> DataFrame:
    """``doc_id, path, license, score, share`` of every row; ``share`` is the part of the text in licence windows."""
    files = files.select("doc_id", "path", "text", F.xxhash64("doc_id", "path", "text").alias("_key"))
    n = files.count()
    near = near_terms(files)
    asked = near.select("_key", F.explode("terms").alias("term"))
    df = checkpointed(frequencies(files).join(asked.select("term").union(files.sparkSession.createDataFrame([(t,) for t in _VOCABULARY], "term string")).distinct(), "term"))
    fixed = {r["term"]: r["df"] for r in df.where(F.col("term").isin(_VOCABULARY)).collect()}
    given = skew_join(asked, df, "term").groupBy("_key").agg(F.collect_list("term").alias("terms"), F.collect_list("df").alias("dfs"))
    given = checkpointed(near.select("_key").join(given, "_key", "left"))
    kind = files.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(n, fixed)
        for batch in batches:
            names, scores, shares = [], [], []
            for text, terms, dfs in zip(*(batch.column(c).to_pylist() for c in ("text", "terms", "dfs")), strict=True):
                name, score, share = scorer.own(text or "", dict(zip(terms or (), dfs or (), strict=True)))
                names.append(name)
                scores.append(score)
                shares.append(share)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("path"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())],
                names=["doc_id", "path", "license", "score", "share"],
            )

    marks = given.select(F.col("_key").alias("_mark"))
    hinted = maybe_in(files, marks, "_key", "_mark").join(given, "_key", "left").select("doc_id", "path", "text", "terms", "dfs")
    scored = hinted.mapInArrow(scan, f"doc_id {kind}, path string, license string, score double, share double")
    rest = maybe_in(files, marks, "_key", "_mark", keep=False)
    none = F.lit(None).cast("string")
    return scored.union(rest.select("doc_id", "path", none.alias("license"), F.lit(0.0).alias("score"), F.lit(0.0).alias("share")))


def directories(path: Column) -> Column:
    """All directories above a path, the root ('') included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def scan(files: DataFrame) -> DataFrame:
    """``doc_id, path, license, score, kind, license_path`` of every row of ``files`` (doc_id, path, text)."""
    own = checkpointed(own_licences(files))
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    held = own.where((F.col("license").isNotNull()) & (F.col("share") >= FILE_SHARE) & F.col("path").isNotNull())
    order = F.struct((-F.col("score")).alias("s"), F.col("license").alias("license"), F.col("path").alias("path"))
    held = held.withColumn("folder", folder).groupBy("folder").agg(F.min(order).alias("best"), F.max("score").alias("top"))
    bare = own.where("license IS NULL AND path IS NOT NULL").select("path").distinct()
    asked = bare.select("path", F.explode(directories(F.col("path"))).alias("folder"))
    depth = F.size(F.split("folder", "/")) + F.when(F.col("folder") == "", -1).otherwise(0)
    near = skew_join(asked, held, "folder").groupBy("path").agg(F.max(F.struct(depth.alias("depth"), F.col("best.license").alias("license"), F.col("best.path").alias("from"), "top")).alias("near"))
    with_own = own.where("license IS NOT NULL OR path IS NULL").select(
        "doc_id", "path", "license", "score", F.when(F.col("license").isNull(), F.lit(None)).when(F.col("share") >= FILE_SHARE, "file").otherwise("header").alias("kind"), F.when(F.col("license").isNotNull(), F.col("path")).alias("license_path")
    )
    inherited = own.where("license IS NULL AND path IS NOT NULL").select("doc_id", "path").join(near, "path", "left").select(
        "doc_id", "path", F.col("near.license").alias("license"), F.coalesce("near.top", F.lit(0.0)).alias("score"), F.when(F.col("near").isNotNull(), "inherited").alias("kind"), F.col("near.from").alias("license_path")
    )
    return with_own.unionByName(inherited)
