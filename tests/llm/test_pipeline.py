import re
from collections import Counter

import corpus_pipeline
from cdcmart.llm import mixing
from cdcmart.llm.common import table
from cdcmart.llm.queries import QUERIES, SQL
from test_jaccard_and_suffix import linked
from test_toxicity_and_packing import check_packing

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_by_brute_force(spark, documents):
    documents([])
    docs = table(spark, FOLDER, "documents")
    rows, columns = docs.collect(), docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        result = out.collect()
        if name == "toxicity":
            clean = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic = 0").collect()}
            assert {r.doc_id for r in result} <= {r.doc_id for r in rows} and len(clean - {r.doc_id for r in result}) <= 2
        elif name == "exact dedup":
            best = {}
            for r in rows:
                key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
                best[key] = min(best.get(key, (0, r.doc_id + 10**9)), (-len(r.text), r.doc_id))
            assert {r.doc_id for r in result} == {i for _, i in best.values()}
        elif name.startswith("n-gram"):
            assert {r.doc_id for r in result} == {c for _, c, _ in linked([(r.doc_id, r.text, "") for r in rows]).values()}
        elif name.startswith("mixing"):
            copies = {r.doc_id: r.copies for r in mixing.report(docs).collect()}
            assert Counter(r.doc_id for r in result) == Counter({i: n for i, n in copies.items() if n})
        else:
            check_packing([(r.doc_id, r.text, "") for r in rows], result, 2048)
        if number < 4:
            assert out.columns == columns
            docs = spark.createDataFrame(result, docs.schema)
            rows = result
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_gives_the_last_stage(spark, documents):
    documents([])
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    docs = {r.doc_id for r in table(spark, FOLDER, "documents").collect()}
    assert pieces and {p.doc_id for p in pieces} <= docs


def test_every_dealt_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)
