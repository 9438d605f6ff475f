import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from cdcmart.llm import jaccard_join, suffix_dedup
from cdcmart.llm.common import components
from conftest_llm import odd_rows


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(rows):
    sets = {i: shingles(t) for i, t, _ in rows}
    root, links = {i: i for i in sets}, defaultdict(int)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


def near_copies(words, groups=12, size=14):
    """Groups of edits of one text, around the threshold; passages that many groups share."""
    rng, rows, shared = random.Random(5), [], words(40, 99)
    for g in range(groups):
        base = words(rng.choice((6, 30, 80, 300)), 1000 + g).split()
        if g % 3 == 0:
            base = shared.split() + base
        for _ in range(size):
            text = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4, 7))):
                text[rng.randrange(len(text))] = f"edit{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text).title() if rng.random() < 0.3 else "  ".join(text), "s"))
    return rows


def test_components_and_links_equal_brute_force(documents, words):
    rows = near_copies(words) + [(1000 + i, words(3, i % 4), "s") for i in range(12)] + [(2000, None, "s"), (2001, " \n", "s")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.report(documents(rows, clashing=True)).collect()}
    assert got == linked(rows)


@pytest.mark.parametrize("block", [3, 40])
def test_blocks_lose_no_link(documents, words, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_copies(words, groups=3, size=40)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.report(documents(rows)).collect()}
    assert got == linked(rows)


def test_divide_skip_equals_intersection():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 120, rng.integers(1, 90)).astype(np.uint64)) for _ in range(60)]
    sets += [np.union1d(s[: len(s) - 1], np.array([500 + i], np.uint64)) for i, s in enumerate(sets) if len(s) > 4]
    lists, sizes = jaccard_join.inverted(sets), np.array([len(s) for s in sets])
    for s in sets:
        want = [j for j, t in enumerate(sets) if len(np.intersect1d(s, t)) * 100 >= 80 * len(np.union1d(s, t))]
        assert jaccard_join.divide_skip(s, lists, sizes).tolist() == want


def test_odd_documents(documents, words):
    rows = odd_rows(words)
    got = jaccard_join.report(documents(rows, clashing=True)).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id))
    assert by[1] == {(0, 1)} and by[3] == {(0, 3)} and by[4] == by[6] == {(1, 4)} and by[8] == {(max(by[8])[0], 7)} and {c for _, c in by[None]} == {None}
    assert jaccard_join.report(documents([])).count() == 0


def test_one_document_of_each_group_stays(documents, words):
    rows = near_copies(words, 4, 8)
    docs = documents(rows, clashing=True)
    kept = jaccard_join.representatives(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c, _ in linked(rows).values()}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(7, 7), (1, 2), (2, 1)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 580)}, 1: 1, 2: 1}


def removed(texts):
    """Brute force over every window."""
    seen = defaultdict(int)
    for t in texts:
        for i in range(len(t) - suffix_dedup.MATCH + 1):
            seen[t[i : i + suffix_dedup.MATCH]] += 1
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - suffix_dedup.MATCH + 1):
            if seen[t[i : i + suffix_dedup.MATCH]] > 1:
                mask[i : i + suffix_dedup.MATCH] = b"\1" * suffix_dedup.MATCH
        kept = bytes(c for c, m in zip(t, mask, strict=True) if not m)
        out.append((len(t), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest()))
    return out


def repeating_rows(words):
    passage, other = words(90, 11), words(120, 12)
    texts = [words(150, i) + " " + passage + " " + words(60, 50 + i) for i in range(7)]
    texts += [passage[30:] + other, other[: 399], other[: 400], other[5:405] + "x", passage * 3, "a" * 1500, "a" * 399, "é" * 450]
    texts += [words(300, 77)] * 3 + [None, "", words(300, 77)[:-1]]
    return [(i, t, "s") for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [2, 3000])
def test_removed_bytes_equal_brute_force(documents, words, hot):
    rows = repeating_rows(words)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(documents(rows, clashing=True), hot).collect()}
    want = removed([(t or "").encode() for _, t, _ in rows])
    assert got == {i: w for (i, _, _), w in zip(rows, want, strict=True)}


def test_suffix_array_and_common_prefixes_equal_sorting():
    rng = np.random.default_rng(3)
    pieces = [bytes(rng.choice([97, 98], 900).astype(np.uint8)), b"ab" * 500, b"a" * 700]
    pieces += [pieces[0][40:], pieces[0][:600] + pieces[1][:300]]
    text = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.array([len(p) for p in pieces])
    ends = np.cumsum(lengths)
    room = np.repeat(ends, lengths) - np.arange(len(text))
    starts = np.flatnonzero(room >= suffix_dedup.MATCH)
    whole = text.tobytes()
    heads = [whole[i : i + suffix_dedup.MATCH] for i in suffix_dedup.suffix_array(text, starts, room).tolist()]
    assert heads == sorted(heads)
    ordered = suffix_dedup.suffix_array(text, starts, room)
    shared = suffix_dedup.common_prefixes(text, ordered, ends - lengths, lengths - suffix_dedup.MATCH + 1)
    for a, b, n in zip(heads[:-1], heads[1:], shared[1:].tolist(), strict=True):
        assert n == next((k for k in range(suffix_dedup.MATCH) if a[k] != b[k]), suffix_dedup.MATCH)


def test_suffix_dedup_of_odd_documents(documents, words):
    rows = odd_rows(words)
    got = suffix_dedup.report(documents(rows, clashing=True)).collect()
    assert len(got) == len(rows)
    long = [r for r in got if r.doc_id == 7][0]
    assert long.n_removed == long.n_bytes and long.n_spans == 1
    assert suffix_dedup.report(documents([])).count() == 0
