import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from cdcmart.llm import periodic_runs, secret_scan, spelling_variants
from conftest_llm import odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs ---


def runs_of(words):
    """Every run by looking at each period and each stretch."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def with_tail(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected_runs(doc_id, text):
    words = with_tail(doc_id, text)
    runs = runs_of(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def text_with_runs(rng):
    words = []
    for _ in range(rng.randint(1, 5)):
        base = [str(rng.randint(0, rng.choice([1, 3, 500]))) for _ in range(rng.randint(1, 60))]
        words += [base[i % len(base)] for i in range(int(len(base) * rng.choice([1, 3, 3.99, 4, 4.5, 9])))]
        words += [str(rng.randint(0, 9)) for _ in range(rng.randint(0, 20))]
    return words * rng.choice([1, 1, 1, 5])


def test_runs_of_many_texts_equal_brute_force():
    rng = random.Random(1)
    for _ in range(15):
        texts = [[w.encode() for w in text_with_runs(rng)] for _ in range(rng.randint(1, 8))]
        assert periodic_runs.Slice(texts).runs() == [runs_of(t) for t in texts]


def test_runs_of_nothing():
    assert periodic_runs.Slice([]).runs() == []
    assert periodic_runs.Slice([[], [], [b"a"]]).runs() == [[], [], []]


@pytest.mark.parametrize("b", [8, 64, 512])
def test_zero_mismatches_are_exact(b):
    rng = np.random.default_rng(b)
    for largest in (2, 5, 1 << 20):  # the last needs several primes
        windows = rng.integers(0, largest, (6, 2 * b - 1)).astype(np.uint64)
        blocks = rng.integers(0, largest, (6, b)).astype(np.uint64)
        for i in range(4):
            blocks[i] = windows[i, i : i + b]
        blocks[3, b // 2] += np.uint64(1)
        want = np.array([[(windows[i, j : j + b] == blocks[i]).all() for j in range(b)] for i in range(6)])
        assert (periodic_runs.zero_mismatches(blocks, windows) == want).all() and want[:3].any(axis=1).all()


def test_transform_is_inverted():
    rows = np.arange(3 * 32, dtype=np.uint64).reshape(3, 32)
    for prime, generator in periodic_runs.PRIMES:
        assert (periodic_runs.inverse(periodic_runs.transform(rows, prime, generator), prime, generator) == rows).all()


def test_one_word_a_hundred_thousand_times_is_one_run():
    assert periodic_runs.Slice([[b"a"] * 100_000 + [b"b"]]).runs() == [[(0, 100_000, 1)]]


def test_run_report_equals_brute_force(documents, words):
    rng = random.Random(2)
    rows = [r for r in odd_rows(words) if r[1] is None or len(r[1]) < 10_000] + [(100 + i, " ".join(text_with_runs(rng)), "s") for i in range(120)]
    rows += [(8, "a b \t a b\n" * 40, "nbsp"), (100, "x y " * 30, "same id")]
    got = [tuple(r) for r in periodic_runs.report(documents(rows, clashing=True)).collect()]
    assert sorted(got, key=repr) == sorted((expected_runs(i, t) for i, t, _ in rows), key=repr)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 5
    assert periodic_runs.report(documents([])).count() == 0


def test_a_very_long_text_has_its_run(documents, words):
    long = words(60_000, 3).split()
    text = " ".join(long[:30_000] * 4 + ["end"])
    row = periodic_runs.find(documents([(1, text, "a")])).first()
    assert [tuple(r) for r in row.runs] == [(0, 120_000, 30_000)] and row.n_words == 120_001
    assert row.collapsed == " ".join(long[:30_000] + ["end"])


# --- spelling variants ---


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def expected_variants(counts):
    rows, forms = [], {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v)) if others else None
        forms[w] = best if others and counts[best] >= 2 * n else None
        rows.append([w, forms[w], None, n, len(others), counts[best] if forms[w] else None])
    for row in rows:
        row[2] = row[0]
        while forms[row[2]]:
            row[2] = forms[row[2]]
    return sorted(map(tuple, rows))


def vocabulary(n, rng):
    counts = {}
    while len(counts) < n:
        word = "".join(rng.choice("abcé") for _ in range(rng.randint(5, 8)))
        if rng.random() < 0.3:
            word = "a" * rng.randint(5, 9) + rng.choice(["", "b", "ab"])
        counts[word] = rng.randint(3, 200)
    return counts


@pytest.mark.parametrize("group_places,bundle", [(1 << 16, 2048), (60, 7), (1, 1)])
def test_variants_equal_brute_force_however_groups_are_split(spark, documents, group_places, bundle):
    documents([])  # the package goes to the workers
    counts = vocabulary(300, random.Random(3)) | {"x" * 3000: 9, "x" * 3001: 4, "x" * 2999 + "y": 3}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = sorted(tuple(r) for r in spelling_variants.variants(df, group_places, bundle).collect())
    assert got == expected_variants(counts)


def expected_words(rows):
    counts = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_variant_report_equals_brute_force(documents, words):
    rng = random.Random(4)
    known = [words(1, i) for i in range(150)] + ["ÀÉÎstraße", "Àéîstraße", "İstanbul", "naïveté"]
    texts = [" ".join(rng.choice(known) for _ in range(rng.randint(0, 120))) for _ in range(80)]
    rows = [r for r in odd_rows(words) if r[1] is None or len(r[1]) < 10_000] + [(i, t if i % 3 else t.upper(), "s") for i, t in enumerate(texts)]
    rows += [(None, texts[3], "s"), (5, texts[4], "same id"), (900, "separate " * 30 + "seperate " * 9 + "sepperate " * 4 + "naivete " * 9 + "naïvete " * 4, "s")]
    got = sorted(tuple(r) for r in spelling_variants.report(documents(rows, clashing=True)).collect())
    assert got == expected_variants(expected_words(rows)) and sum(r[1] is not None for r in got) >= 3


def test_variants_of_nothing(documents):
    assert spelling_variants.report(documents([])).count() == 0
    assert spelling_variants.report(documents([None, "", "a b c"])).count() == 0


def test_a_hot_group_is_split_and_pairs_are_found_once(spark, documents):
    documents([])
    counts = {f"common{a}{b}": 3 + i for i, (a, b) in enumerate((a, b) for a in "abcdefghijklmnopq" for b in "abcdefghijklmnopq")}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    members = spelling_variants.groups(df, 400)
    assert max(r["count"] for r in members.groupBy("_group").count().collect()) * 2 <= 400
    assert sorted(tuple(r) for r in spelling_variants.variants(df, 400, 16).collect()) == expected_variants(counts)


# --- secrets ---

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ALLOWED = re.compile("|".join(f"(?:{p})".replace("(?:(?i)", "(?i:") for p in secret_scan.ALLOWED))


def entropy_spans(text):
    size, out = secret_scan.WINDOW, []
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        c, spans = m[0], []
        allowed = [a.span() for a in ALLOWED.finditer(c)]
        for i in range(len(c) - size + 1):
            counts = Counter(c[i : i + size])
            k = [sum(counts[x] for x in chars) for chars in secret_scan.CLASSES]
            entropy = math.log2(size) - sum(round(v * math.log2(v) * 2**30) for v in counts.values()) / size / 2**30
            least = 3.0 if k[2] + k[4] + k[5] == 0 and not (k[1] and k[3]) else 3.9 if k[5] else 3.8
            if entropy >= least and k[0] >= 2 and k[0] + k[5] < size and not any(a < i + size and b > i for a, b in allowed):
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + size
                else:
                    spans.append([i, i + size])
        out += [(m.start() + a, 3, m.start() + b) for a, b in spans]
    return out


def expected_secrets(doc_id, text):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    further = [e for e in entropy_spans(text) if not any(b[0] <= e[0] and e[2] <= b[2] for b in base)]
    listed = lambda spans: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return (doc_id, *(sum(b[1] == k for b in base) for k in range(3)), sha(listed(base)), listed(base + further))


def text_with_secrets(rng):
    signs = secret_scan.ALPHABET
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    parts = [
        f'token = "{some("0123456789abcdef.", rng.randint(3, 50))}', "secret=token: abcdefg", "PassWord:=x", "AKIA" + some("AKI012", rng.randint(10, 30)),
        some("0123456789abcdef", rng.randint(20, 60)), some(signs, rng.randint(20, 300)), "élan 😀 ſecret", "123e4567-e89b-12d3-a456-426614174000", "aaa" * 30 + "key",
        "API_KEY':   \"" + some(signs, rng.randint(1, 9)), "https://a.b/" + some("abcdefghijklmnopqrstuvwxyz", 40), some(signs, 30) + "EXAMPLE" + some(signs, 70),
        some("0123456789ABCDEF", 40),
    ]
    return rng.choice([" ", "\n", "é", "", ". "]).join(rng.choice(parts) for _ in range(rng.randint(1, 12)))


def test_secret_report_equals_brute_force(documents, words):
    rng = random.Random(5)
    rows = odd_rows(words) + [(100 + i, text_with_secrets(rng), "s") for i in range(150)]
    rows += [(90, " ".join(text_with_secrets(rng) for _ in range(150)), "long"), (91, "".join(rng.choice(secret_scan.ALPHABET) for _ in range(3000)), "blob"), (100, "deadbeef" * 4, "same id")]
    got = [tuple(r) for r in secret_scan.report(documents(rows, clashing=True)).collect()]
    want = [expected_secrets(i, t) for i, t, _ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum("entropy" in w[-1] for w in want) > 30
    assert secret_scan.report(documents([])).count() == 0


def test_secret_scan_stays_in_the_jvm_and_does_not_shuffle(documents):
    plan = secret_scan.report(documents(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_allow_list_is_a_parameter(documents):
    key = "q9X2mB7vK4pT8sW1zR6y-N3c/Lf5+H0jD"
    rows = [(1, f"see {key} there", "a")]
    assert [tuple(s) for s in secret_scan.find(documents(rows)).first().spans] == [(4, 3, 4 + len(key))]
    assert secret_scan.find(documents(rows), allowed=("K4pT",)).first().spans == []
