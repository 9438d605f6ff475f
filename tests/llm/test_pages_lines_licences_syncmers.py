import hashlib
import random
import struct
from collections import Counter, defaultdict

import xxhash

from cdcmart.llm import common, license_scan, site_style_tree, syncmers, template_lines
from conftest_llm import odd_rows


def text_of(page):
    blocks, _ = site_style_tree.blocks_of(page)
    return "\n".join(blocks[i].text for i in site_style_tree.main_blocks(blocks))


def test_declared_regions_and_mark_up_go():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no";</script></head><body>
    <nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">Cookies</div><header>Top</header>
    <article><h1>Head &amp;  line</h1><!-- <p>hidden</p> --><p>One <b>bold</b>word,
    two<br>three<p>four &lt;x&gt; &#233;&nbsp;y<ul><li>a<li>b</ul><div class="ad">Buy</div><form><label>Mail</label></form>
    <table><tr><td>c<td>d</table><aside>See also</aside><section id="comments"><p>First!</p></section></article>
    <footer>&copy; me</footer></body></html>"""
    assert text_of(page) == "Head & line\nOne boldword, two\nthree\nfour <x> é y\na\nb\nc\nd"


def test_broken_pages():
    assert text_of("") == "" and text_of("plain < text & more") == "plain < text & more"
    assert text_of("<p>a<p>b</div></p>c<!-- open") == "a\nb\nc"
    assert text_of("<article><p>x<script>never ends") == "x"
    assert text_of('<p title="a>b">t</p><a href=x>u') == "t\nu"
    assert text_of("<div>" * 3000 + "deep") == "deep"
    assert text_of("<article class='comment'>c</article><p>body</p>") == "body"


def site(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "'y' AS _key", "'z' AS host", "1 AS dropped")


def test_repeated_branches_of_a_host_go(spark, documents, words):
    documents([])
    box = "<div class='box7'><p>Our shop is open daily</p><p>Call us now</p></div>"
    rows = [(i, f"https://a.example/{i}", f"<body><div class='main'><p>{words(9, i)}</p><p>{words(9, 100 + i)}</p><p>Best regards</p></div>{box}</body>") for i in range(20)]
    rows += [(100 + i, f"https://b.example/{i}", f"<body><p>{words(5, 900 + i)}</p>{box}</body>") for i in range(3)]  # too few pages to tell
    copies = f"<body><article><p>{words(12, 5000)}</p></article></body>"
    rows += [(200 + i, "https://a.example/copy", copies) for i in range(30)]
    got = {r.page_id: r for r in site_style_tree.extract(site(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i in range(20):
        assert got[i].text == f"{words(9, i)}\n{words(9, 100 + i)}"
    for i in range(3):
        assert got[100 + i].text == f"{words(5, 900 + i)}\nOur shop is open daily\nCall us now"
    assert {got[200 + i].text for i in range(30)} == {words(12, 5000)} and got[0].n_chars == len(got[0].text)


def test_an_article_keeps_what_only_its_names_suspect(spark, documents):
    documents([])
    page = """<body><article><header class="entry-header"><h1>Title {0}</h1></header><h2 id="login">Logging in {0}</h2><p class="alert">Mind {0}</p>
    <section id="related-work"><h3>Related {0}</h3><p>Work {0}</p></section><div class="article-header">Part {0}</div><p>Plain {0}</p>
    <div class="share-bar">Share me</div><section id="comments"><p>First {0}</p></section></article></body>"""
    rows = [(i, f"https://n.example/{i}", page.format(i)) for i in range(30)]
    for r in site_style_tree.extract(site(spark, rows)).collect():
        i = r.page_id
        assert r.text == f"Title {i}\nLogging in {i}\nMind {i}\nRelated {i}\nWork {i}\nPart {i}\nPlain {i}"


def test_the_tree_decides_inside_articles_too(spark, documents, words):
    documents([])
    share = "<div class='x9'><h4>Like it?</h4><p>Tell all your friends about this page</p></div>"
    rows = [(i, f"https://a.example/{i}", f"<body><p>{i}</p><article><h1>News</h1><p>{words(20, i)}</p><p>{words(9, 500 + i)}</p>{share}</article></body>") for i in range(40)]
    # copies of one article whose surroundings differ, and near copies with one passage changed
    rows += [(100 + i, f"https://c.example/{i}", f"<body><p>{words(3, i)}</p><article><p>{words(20, 1)}</p><p>{words(9, 2)}</p></article></body>") for i in range(40)]
    rows += [(200 + i, f"https://d.example/{i}", f"<body><article><p>{words(30, 3)}</p><p>{words(20, 4)}</p><p>{words(9, 600 + i)}</p></article></body>") for i in range(40)]
    got = {r.page_id: r.text for r in site_style_tree.extract(site(spark, rows)).collect()}
    for i in range(40):
        assert got[i] == f"News\n{words(20, i)}\n{words(9, 500 + i)}"
        assert got[100 + i] == f"{words(20, 1)}\n{words(9, 2)}"
        assert got[200 + i] == f"{words(30, 3)}\n{words(20, 4)}\n{words(9, 600 + i)}"


def test_odd_pages(spark, documents):
    documents([])
    rows = [(1, None, None), (2, "", ""), (None, "http://x", "<p>t"), (3, "odd", "<p>t</p>"), (3, "odd", "<p>t</p>"), (4, "http://x", "<p>" + "w " * 200_000)]
    got = site_style_tree.extract(site(spark, rows)).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 1, 1, 1, 399_999]
    assert site_style_tree.extract(site(spark, []) if rows is None else site(spark, rows).where("false")).count() == 0


def test_recurring_templates_are_dropped(documents, words):
    rows = [(i, f"{words(7, i)}\nPage {i} of {i + 7} printed on day {i * 3}\n\n{words(5, 300 + i)}", "s") for i in range(30)]
    rows += [(100 + i, "Shared by copies only\n" + words(6, 1), "s") for i in range(40)]
    rows += [(200 + i, f"Posted by user {['ann', 'bob', 'cy'][i % 3]} in the news forum today", "s") for i in range(24)]
    got = {r.doc_id: r for r in template_lines.deduplicate(documents(rows, clashing=True)).collect()}
    for i in range(30):
        assert (got[i].text, got[i].n_lines, got[i].n_dropped) == (f"{words(7, i)}\n\n{words(5, 300 + i)}", 4, 1)
    assert got[100].n_dropped == 0  # copies count once
    odd = template_lines.deduplicate(documents(odd_rows(words), clashing=True)).collect()
    assert len(odd) == len(odd_rows(words)) and all(r.n_dropped == 0 for r in odd)
    assert template_lines.deduplicate(documents([])).count() == 0


def test_variable_fields_without_digits_are_generalised(documents, words):
    names = [words(1, 40 + i) for i in range(40)]
    rows = [(i, f"Written by the author {names[i]} for our daily review\n{words(9, i)}", "s") for i in range(40)]
    got = template_lines.deduplicate(documents(rows)).collect()
    assert {r.n_dropped for r in got} == {1} and all(r.text == words(9, r.doc_id) for r in got)


def test_lines_run_on_the_jvm_alone(documents):
    for df in (template_lines.deduplicate(documents(["a\nb"])), syncmers.report(documents(["a b"]))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_licences_are_found_and_inherited(spark, documents, words):
    documents([])
    gpl, mit = "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License."
    rows = [(1, "a/LICENSE", gpl), (2, "a/b/x.txt", words(300, 1)), (3, "a/b/c/y.txt", words(90, 2) + "\n" + mit + "\n" + words(200, 3)), (4, "a/d/LICENSE", mit),
            (5, "a/d/e/f/z.txt", words(50, 4)), (6, "other/q.txt", words(50, 5)), (7, None, None), (8, None, mit), (9, "top.txt", ""), (2, "a/b/x.txt", words(300, 1))]
    rows += [(50 + i, f"n/{i}", words(80, 60 + i) + " the licence of the driver expired") for i in range(20)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "'x' AS score", "'y' AS folder")
    got = {r.doc_id: (r.license, r.kind, r.license_path) for r in license_scan.scan(files).collect()}
    assert got[1] == ("GPL-3.0", "file", "a/LICENSE") and got[2] == ("GPL-3.0", "inherited", "a/LICENSE")
    assert got[3] == ("MIT", "header", "a/b/c/y.txt") and got[5] == ("MIT", "inherited", "a/d/LICENSE")
    assert got[6] == (None, None, None) == got[7] == got[9] and got[8][:2] == ("MIT", "file")
    assert {got[50 + i][0] for i in range(20)} == {None} and license_scan.scan(files).count() == len(rows)
    assert license_scan.scan(files.where("false")).count() == 0


def closed_syncmers(text):
    """Number of anchors by definition."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    pair = lambda a, b: xxhash.xxh64_intdigest(struct.pack("<Q", b), seed=xxhash.xxh64_intdigest(struct.pack("<Q", a), seed=42))
    runs = [signed(pair(a, b)) for a, b in zip(words, words[1:])] if len(words) > 1 else words
    width = syncmers.K - syncmers.S + 1
    if len(runs) < width:
        return len(runs)
    return sum(min(runs[i : i + width]) in (runs[i], runs[i + width - 1]) for i in range(len(runs) - width + 1)) or len(runs)


def anchors(fingerprint):
    return {fingerprint[i : i + 8] for i in range(0, len(fingerprint), 8)}


def test_fingerprints_edits_and_neighbours(documents, words, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET", 7)
    rng = random.Random(3)
    rows = [(i * 17 % 1009, words(rng.choice((1, 3, 6, 7, 8, 20, 150)), i % 60), "s") for i in range(80)] + [(5000, None, "s"), (-3, "é你 \U0001f600 x", "s")]
    got = {r.doc_id: r for r in syncmers.report(documents(rows, clashing=True)).collect()}
    texts = {i: t or "" for i, t, _ in rows}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        text, following = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r, n = got[i], got[order[(k + 1) % len(order)]]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r.fingerprint) == 8 * closed_syncmers(text) and len(r.edited_fingerprint) == 8 * closed_syncmers(edited)
        for a, b, near in ((r.fingerprint, r.edited_fingerprint, r.near_edited), (r.fingerprint, n.fingerprint, r.near_next)):
            a, b = anchors(a), anchors(b)
            assert abs(near - (2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0)) < 1e-12
    by_text = {}
    for i, t in texts.items():
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def test_short_and_unspaced_texts_have_fingerprints_of_their_own(documents, words):
    rows = [(i, words(6 + i % 3, 2000 + i), "s") for i in range(60)]
    got = syncmers.report(documents(rows)).collect()
    assert all(r.fingerprint for r in got) and max(r.near_next for r in got) < 0.5
    rng = random.Random(5)
    unspaced = ["".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(300)) + "\U0001f600" * (i % 2) for i in range(6)]
    got = syncmers.report(documents([(i, t, "s") for i, t in enumerate(unspaced)])).collect()
    # half of the text is kept, so about half of the anchors are
    assert all(0.3 < r.near_edited < 0.7 and r.near_next == 0 for r in got)


def test_fingerprints_of_odd_documents(documents, words):
    rows = odd_rows(words)
    got = syncmers.report(documents(rows, clashing=True)).collect()
    assert len(got) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = syncmers.report(documents([(7, "a b c d e f g h", "s")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert syncmers.report(documents([])).count() == 0


def test_everyday_words_and_line_breaks_hide_no_licence():
    # document frequencies of a million files; the other words of the lines are in most of them
    df = {"released": 20_000, "licensed": 20_000, "under": 700_000, "the": 990_000, "mit": 9_000, "license": 30_000}
    scorer = license_scan.Scorer(1_000_000, df)
    common = {t: 600_000 for t in "see copying by for our about all these files please".split()}
    for text in ("// Released under the MIT license by Acme", "# Licensed under the MIT license, see COPYING", "about all these files: released\n# under the\n# MIT\n# license for our files " + "please see all " * 40):
        name, score, _ = scorer.own(text, {**common, "acme": 3})
        assert name == "MIT" and score > 0.9
    assert scorer.own("the licence of the driver expired", {})[0] is None


def test_frequencies_of_all_terms_are_counted(spark, documents):
    documents([])
    files = spark.createDataFrame([("see our licence",), ("see me, see",), (None,)], "text string")
    assert {r.term: r.df for r in license_scan.frequencies(files).collect()} == {"see": 2, "our": 1, "licence": 1, "me": 1}


def test_leading_tokens_alone_make_no_template(documents, words):
    names = [words(1, 700 + i) for i in range(40)]
    rows = [(i, f"from typing import {names[i]}\nHow to make {names[i]} quickly{i % 2 * 'er'}{names[39 - i]}\nSee page {i}\n{words(9, i)}", "s") for i in range(40)]
    got = template_lines.deduplicate(documents(rows)).collect()
    assert len(set(names)) > 30 and {r.n_dropped for r in got} == {1}
    assert all(r.text.startswith("from typing import ") and "How to make" in r.text and "See page" not in r.text for r in got)


def tree_templates(leaf, min_docs=template_lines.MIN_DOCS):
    """Template of each line of one leaf by definition: {tokens: lines that hold them} to {tokens: number of a template}."""
    out, depth = {}, template_lines.DEPTH

    def node(lines, before):
        total = sum(lines.values())
        if total < min_docs:
            return
        held = Counter()
        for tokens, many in lines.items():
            held.update({(at, t): many for at, t in enumerate(tokens) if at >= depth})
        held = {k: n for k, n in held.items() if n >= template_lines.AGREE * min_docs}
        places = sorted({at for at, _ in held})
        top = {at: min((-n, t) for (a, t), n in held.items() if a == at) for at in places}
        constant = {(at, t) for at, (n, t) in top.items() if -n >= template_lines.AGREE * total}
        number, stay = len(out), {}
        for tokens, many in lines.items():
            mine = {(at, t) for at, t in enumerate(tokens) if at >= depth}
            least = template_lines.SIMILAR * (len(tokens) - depth)
            if len(mine & constant) >= least and mine & held.keys():
                out[tokens] = number
            elif len(mine & held.keys()) >= least:
                stay[tokens] = many
        if total != before:
            return node(stay, total)
        part = {k: n for k, n in held.items() if min_docs <= n < total}
        if part:
            cut = min((-sum(n for (a, _), n in part.items() if a == at), at) for at, _ in part)[1]
            children = defaultdict(dict)
            for tokens, many in stay.items():
                children[tokens[cut] if (cut, tokens[cut]) in part else None][tokens] = many
            for child in children.values():
                node(child, None)

    node(leaf, None)
    return out


def test_two_templates_of_a_leaf_are_both_dropped_whatever_else_is_in_it(documents, words):
    names = [words(1, 900 + i) for i in range(30)]
    rows = [(i, f"Sent by the forum of {names[i]} for all members today\n{words(9, i)}", "s") for i in range(30)]
    rows += [(100 + i, f"Sent by the editors and {names[i]} with many kind regards\n{words(9, 200 + i)}", "s") for i in range(30)]
    prose = [(1000 + i, f"Sent by the {words(8, 3000 + i)}", "s") for i in range(300)]
    for more in ([], prose):
        got = {r.doc_id: r for r in template_lines.deduplicate(documents(rows + more)).collect()}
        assert {got[i].n_dropped for i, _, _ in rows} == {1} and {got[i].n_dropped for i, _, _ in more} <= {0}


def test_dropped_lines_equal_a_tree_by_definition(documents):
    rng, rows = random.Random(8), []
    forms = [[rng.choice("abcdef") + str.lower(rng.choice("XYZ")) for _ in range(6)] for _ in range(9)]
    for i in range(260):
        form = list(rng.choice(forms))
        for _ in range(rng.choice((0, 1, 1, 2, 3, 5))):
            form[rng.randrange(6)] = rng.choice(["ann", "bob", "cy", "di"]) if rng.random() < 0.5 else "w" + "".join(rng.choices("ghijk", k=6))
        rows.append((i, " ".join(["the", "same", "start", *form]) + f"\nown {'x' * (i + 1)}", "s"))
    leaf = Counter(tuple(t.split("\n")[0].split(" ")) for _, t, _ in rows)
    template = tree_templates(leaf)
    of = {i: template.get(tuple(t.split("\n")[0].split(" ")), t.split("\n")[0]) for i, t, _ in rows}
    docs = Counter(of.values())
    want = {i: int(docs[of[i]] >= template_lines.MIN_DOCS) for i in of}
    got = {r.doc_id: r.n_dropped for r in template_lines.deduplicate(documents(rows)).collect()}
    assert got == want and 0 < sum(want.values()) < len(want) and len(set(template.values())) > 2


def test_rounds_build_no_table_on_the_driver(documents, words, monkeypatch):
    plans, keep = [], template_lines.checkpointed

    def checkpointed(df):
        out = keep(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    rows = [(i, f"Sent by the forum of {words(1, i)} for all members\nSent by the {words(6, 500 + i)} today", "s") for i in range(30)]
    monkeypatch.setattr(template_lines, "checkpointed", checkpointed)
    before = template_lines._round
    rounds = []

    def a_round(*args):
        start = len(plans)
        out = before(*args)
        rounds.append(start)
        return out

    monkeypatch.setattr(template_lines, "_round", a_round)
    got = template_lines.deduplicate(documents(rows))
    assert {r.n_dropped for r in got.collect()} == {1}
    # a round checkpoints its counted tokens, then what becomes of its lines
    of_rounds = [plan for start in rounds for plan in plans[start : start + 2]]
    assert of_rounds and not any("BroadcastExchange" in plan for plan in of_rounds)
    assert all("isFinalPlan=true" in plan and "SortMergeJoin" in plan for plan in of_rounds)
    # the words of the changed documents are sent once for both parts of the result
    final = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final


def test_a_node_that_keeps_its_lines_is_split_at_once(documents, words, monkeypatch):
    rounds, before = [], template_lines._round
    monkeypatch.setattr(template_lines, "_round", lambda *args: rounds.append(1) or before(*args))
    # two templates that share no token, neither with half of the lines: split, then each is found
    rows = [(i, f"Sent by the {form} {words(1, 50 + i)}", "s") for k, form in enumerate(("forum of our town", "editors and their friends", "x y z u")) for i in range(100 * k, 100 * k + 12)]
    got = template_lines.deduplicate(documents(rows)).collect()
    assert {r.n_dropped for r in got} == {1} and len(rounds) == 2


def test_a_split_by_bitmaps_sends_few_rows_to_the_driver(spark, documents, monkeypatch):
    documents([])
    sent, keep = [], common.checkpointed
    monkeypatch.setattr(common, "checkpointed", lambda df: sent.append(keep(df)) or sent[-1])
    rows = spark.range(20_000).selectExpr("if(id % 1000 = 7, null, id) AS k", "id")
    keys = spark.range(0, 20_000, 4).selectExpr("id AS m").union(spark.range(1).selectExpr("cast(null AS bigint)"))
    changed, same = (x.collect() for x in common.maybe_split(rows, keys, "k", "m"))
    assert sorted(r.id for r in [*changed, *same]) == list(range(20_000))
    assert not [r for r in same if r.k is not None and r.k % 4 == 0] and len(changed) < 5000 + 1500
    assert sum(len(r._bits) for x in sent for r in x.collect()) <= 4 * 5001 * 16 / 8
    none, all_rows = common.maybe_split(rows, keys.where("false"), "k", "m")
    assert none.count() == 0 and all_rows.count() == 20_000
