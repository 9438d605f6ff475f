import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from cdcmart.llm import packing, toxicity
from conftest_llm import odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def maximal(scores):
    """Maximal scoring subsequences by definition: cut out the best one, then look left and right of it."""
    if not len(scores) or max(scores) <= 0:
        return []
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if best is None or total > best[0] + 1e-9 or (abs(total - best[0]) <= 1e-9 and b - a < best[2] - best[1]):
                best = (total, a, b)
    _, a, b = best
    return maximal(scores[:a]) + [(a, b + 1, best[0])] + [(x + b + 1, y + b + 1, s) for x, y, s in maximal(scores[b + 1 :])]


def test_segments_equal_the_definition():
    rng = random.Random(4)
    for _ in range(200):
        scores = np.array([rng.choice([-3.1, -1.3, -0.2, 0.7, 2.9]) + rng.random() / 100 for _ in range(rng.randint(1, 25))])
        got = toxicity.segments(scores)
        want = maximal(scores.tolist())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_segments_take_linear_time():
    scores = np.tile([1.0, -0.5], 200_000)
    assert len(toxicity.segments(scores)) == 1
    assert len(toxicity.segments(np.tile([1.0, -2.0], 50_000))) == 50_000


@pytest.fixture
def labelled(spark, documents, words):
    rng = random.Random(1)
    insults = ["grumvort", "plexhag", "zimbludd", "krotwick"]
    rows, labels = [], []
    for i in range(600):
        text = words(rng.choice((8, 60, 300)), 5000 + i).split()
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(insults) + rng.choice(["", "ed", "ish", "ow"]))
        rows.append((i, " ".join(text), "s"))
        labels.append((i, 1, int(bad)))
    return rows, documents(rows, clashing=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(labelled):
    rows, docs, labels = labelled
    got = toxicity.report(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    wrong = [r for r in held if r.predicted != (r.doc_id % 5 == 0)]
    assert len(wrong) <= 0.03 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_labels_of_held_out_rows_change_nothing(labelled):
    rows, docs, labels = labelled
    other = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    one, two = ({r.doc_id: round(r.score, 9) for r in toxicity.report(docs, x).collect()} for x in (labels, other))
    assert one == two


def test_passages_point_at_the_words(labelled):
    rows, docs, labels = labelled
    found = toxicity.passages(docs, toxicity.learn(docs, labels)).where("size(passages) > 0").collect()
    texts = {i: t for i, t, _ in rows}
    for r in found[:40]:
        inside = " ".join(texts[r.doc_id].encode()[p.start : p.stop].decode() for p in r.passages)
        assert re.search("grumvort|plexhag|zimbludd|krotwick", inside)


def test_toxic_rows_go_and_clean_ones_stay(labelled):
    rows, docs, labels = labelled
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns
    predicted = {r.doc_id for r in toxicity.report(docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in rows} - predicted


def test_column_names_with_dots_and_ticks_are_kept(labelled):
    rows, docs, labels = labelled
    odd = docs.selectExpr("*", "1 AS `a.b`", "2 AS `c``d`")
    kept = toxicity.clean(odd, labels)
    assert kept.columns == odd.columns and 0 < kept.count() < len(rows)


def test_toxicity_of_odd_tables(spark, documents, words, labelled):
    rows = odd_rows(words)
    odd_labels = spark.createDataFrame([(4, 1, 1), (4, 0, 0), (None, 1, 1), (6, 1, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.report(documents(rows, clashing=True), odd_labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = odd_labels.where("false")
    assert {r.predicted for r in toxicity.report(documents(rows), none).collect()} == {0}
    assert toxicity.report(documents([]), none).count() == 0 and toxicity.clean(documents([]), odd_labels).count() == 0


def check_packing(rows, pieces, window):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    texts = defaultdict(list)
    for i, t, _ in rows:
        texts[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    for i, several in texts.items():
        ids = several[0]
        if any(ids != other for other in several):  # documents without an id of their own
            assert sum(p.length for p in by_doc[i]) == sum(map(len, several))
            continue
        assert all(p.doc_tokens == len(ids) for p in by_doc[i])
        at = sorted((p.start, p.length) for p in by_doc[i])
        assert sum(n for _, n in at) == len(ids) * len(several)
        for p in by_doc[i]:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        if len(several) == 1:
            assert [s for s, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))]
    padding = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        length = sum(p.length for p in parts)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))] and length <= window
        padding += 0 if length & (length - 1) == 0 else window - length
    assert padding == 0
    return by_sequence


@pytest.mark.parametrize("window,parts", [(64, 5), (2048, 3)])
def test_every_id_is_packed_once(documents, words, window, parts):
    rng = random.Random(9)
    rows = [(i, words(rng.choice((1, 5, 30, 400)), i) + rng.choice(["", ".", " 12 a's 4", " İstanbul Σας ﬁ é <|endoftext|> x²"]), "s") for i in range(150)]
    docs = documents(rows, clashing=True).repartition(parts, "doc_id")
    check_packing(rows, packing.pack(docs, PATH, window).collect(), window)


def test_packing_odd_documents(documents, words):
    rows = odd_rows(words)
    by_sequence = check_packing(rows, packing.pack(documents(rows).coalesce(1), PATH).collect(), 2048)
    assert sum(p.doc_id == 1 for ps in by_sequence.values() for p in ps) == 1
    assert packing.pack(documents([]), PATH).count() == 0


def test_a_piece_goes_where_it_leaves_least_room():
    packer, ids = packing.Packer(10, 2), lambda n: b"\0\0\0\0" * n
    done = [w for doc, n in enumerate((6, 3, 7, 3)) for w in packer.add(doc, ids(n))]
    assert [[p[0] for p in pieces] for _, pieces in done] == [[2, 3]]
    done = [w for doc, n in ((4, 8), (5, 9)) for w in packer.add(doc, ids(n))]
    assert [p[0] for p in done[0][1]] == [0, 1, 5] and sum(len(p[2]) for p in done[0][1]) == 40


def test_whole_words_count_in_every_script(spark, documents, words):
    rng = random.Random(5)
    bad = ["worthlessgit", "“retardon”", "—кретинище", "今天的笨蛋很多"]
    good = ["worthy", "retail", "крепость", "今天的天气很好"]
    rows, labels = [], []
    for i in range(480):
        text = words(40, 9000 + i).split() + good
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            text.insert(rng.randrange(len(text)), bad[i // 4 % 4])
        rows.append((i, " ".join(text), "s"))
        labels.append((i, 1, int(toxic)))
    got = toxicity.report(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("held_out").collect()
    assert {i // 4 % 4 for i in (r.doc_id for r in got) if i % 4 == 0} == {0, 1, 2, 3}
    assert [r.doc_id for r in got if r.predicted != (r.doc_id % 4 == 0)] == []


def test_remembered_words_are_bounded_in_bytes(monkeypatch, words):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "RUNS", 20_000)
    monkeypatch.setattr(packing, "PARTS", 30_000)
    tokenizer, remembered = Tokenizer.from_file(PATH), packing.Words(PATH)
    rng, common = random.Random(3), "Common, words stay. "
    for i in range(12):
        texts = [common + " ".join("".join(rng.choices("abcdeé1-'", k=9)) for _ in range(20)) for _ in range(10)] + ["", " ", words(30, i), "İı x² <|endoftext|> Σας"]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in remembered(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        for memory, most in ((remembered.runs, 20_000), (remembered.parts, 30_000)):
            assert memory.strings.nbytes + memory.ids.nbytes <= most and len(memory.strings) == len(memory.ids) == len(memory.asked)
    assert "common," in remembered.parts.strings.to_pylist()
    remembered.forget()
    assert not len(remembered.parts.strings) and not len(remembered.runs.strings)
