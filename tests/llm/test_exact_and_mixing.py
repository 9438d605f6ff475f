import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from cdcmart.llm import exact_dedup, mixing
from cdcmart.llm.queries import SQL
from conftest_llm import odd_rows


def in_duckdb(sql, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    cursor = con.execute(sql)
    return [dict(zip([d[0] for d in cursor.description], r)) for r in cursor.fetchall()]


def plain(rows):
    return sorted(repr(sorted((k, round(v, 6) if isinstance(v, float) else v) for k, v in (r if isinstance(r, dict) else r.asDict()).items())) for r in rows)


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_exact_report_equals_sql_and_brute_force(documents, words, bits):
    rows = [r for r in odd_rows(words) if r[0] is not None] + [(100 + i, words(5, i % 7), "s") for i in range(60)]
    got = exact_dedup.report(documents(rows, clashing=True), bits).collect()
    if bits > 64:  # a filter of one word flags everything; the result is the same
        assert plain(got) == plain(in_duckdb(SQL["op4_exact_dedup"], rows))
    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id))
    for r in got:
        normal = next(n for n, g in groups.items() if hashlib.sha256(n.encode()).hexdigest() == r.text_sha256)
        assert (r.keep_id, r.group_size) == (min(groups[normal])[1], len(groups[normal])) and r.kept == (r.doc_id == r.keep_id)


def test_exact_dedup_leaves_one_row_of_each_text_with_all_columns(documents, words):
    rows = odd_rows(words)
    docs = documents(rows, clashing=True)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    assert Counter(texts) == Counter({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in rows})
    assert {r.text for r in kept.collect()} >= {"o n e"}  # the longest of its group


def test_exact_dedup_of_nothing(documents):
    assert exact_dedup.report(documents([])).count() == 0 and exact_dedup.deduplicate(documents([])).count() == 0


def test_only_flagged_rows_are_shuffled(documents):
    docs = documents([f"text {i}" for i in range(50)])
    plan = exact_dedup.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def shared_by_rounds(sizes, weights=(5, 2, 1), most=3):
    """The contract's own wording: excess above the cap is shared again by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        free = [n for n in names if n not in full]
        left = total - sum(most * sizes[n] for n in full)
        target = {n: most * sizes[n] if n in full else left * weight[n] / sum(weight[m] for m in free) for n in names}
        above = {n for n in free if target[n] > most * sizes[n]}
        if not above:
            return target
        full |= above


def test_targets_and_taken_words(documents, words):
    rows = [(i, words(1 + i % 40, i), [None, "a", "b", "c", "d", "Z"][min(5, i % 9)]) for i in range(900)]
    rows += [(2000, None, "empty"), (2001, " ", "empty")]
    got = mixing.report(documents(rows, clashing=True)).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sizes = Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    want = shared_by_rounds(sizes)
    taken = Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]] and r.taken <= 3 * r.size
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        assert r.source_size == 0 or r.copies - r.target / r.source_size < 1
        taken[source[r.doc_id]] += r.taken
    for s, target in want.items():
        assert abs(taken[s] - target) <= max(45, 0.02 * target), s
    assert plain(got) == plain(in_duckdb(SQL["op1_mixing"], rows)) == plain(mixing.report(documents(rows)).collect())


def test_a_tiny_source_is_capped_and_the_rest_shared_again(documents, words):
    rows = [(i, words(10, i), "a" if i < 3 else "b" if i < 200 else "c") for i in range(400)]
    got = {r.doc_id: r for r in mixing.report(documents(rows)).collect()}
    assert got[0].target == 90 and got[0].taken == 30


def test_mix_emits_rows_as_often_as_reported(documents, words):
    rows = [(i, words(8, i), f"s{i % 4}") for i in range(300)] + [(None, None, None), (301, "", None)]
    docs = documents(rows, clashing=True)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.report(docs).collect()}
    counted = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counted == {i: n for i, n in copies.items() if n}


def test_the_pure_draw_has_the_fraction_as_probability(documents, words):
    rows = [(i, words(4, 1), "a" if i % 2 else "b") for i in range(4000)]
    got = mixing.report(documents(rows), calibrate=False).collect()
    rate = {r.doc_id % 2: r.target / r.source_size for r in got}
    for parity in (0, 1):
        mean = sum(r.copies for r in got if r.doc_id % 2 == parity) / 2000
        assert abs(mean - rate[parity]) < 0.05


def test_mixing_nothing(documents):
    assert mixing.report(documents([])).count() == 0 and mixing.mix(documents([])).count() == 0
