"""One registered query for each operator, over its whole table with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cdcmart.llm import (
    exact_dedup,
    jaccard_join,
    license_scan,
    mixing,
    packing,
    periodic_runs,
    secret_scan,
    site_style_tree,
    spelling_variants,
    suffix_dedup,
    syncmers,
    template_lines,
    toxicity,
)
from cdcmart.llm.common import ship_package, table

TOKENIZER = "word_bpe_49k.json"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return site_style_tree.extract(table(spark, sf_dir, "pages"))


def op3_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_lines.deduplicate(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.report(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return jaccard_join.report(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a tree: source / language / a thousand ids / hundred ids."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    part = lambda size: F.floor(F.col("doc_id") / size).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), part(1000), part(100), F.col("doc_id").cast("string"))
    return license_scan.scan(docs.select("doc_id", path.alias("path"), "text"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return periodic_runs.report(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spelling_variants.report(table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_site_style_tree,
        op3_template_lines,
        op4_exact_dedup,
        op5_packing,
        op6_syncmers,
        op7_jaccard_join,
        op8_license_scan,
        op9_suffix_dedup,
        op10_toxicity,
        op11_periodic_runs,
        op12_spelling_variants,
        op13_secret_scan,
    )
}

_SQL_MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS draw
  FROM documents),
bins AS (SELECT source, draw // 1048576 AS bin, sum(size)::BIGINT AS words FROM sized GROUP BY ALL),
sources AS (
  SELECT source, sum(words)::BIGINT AS source_size FROM bins GROUP BY source),
weighted AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::BIGINT AS w FROM sources),
shared AS (
  SELECT *, 3 * source_size / w AS ratio,
         ((sum(source_size) OVER ()) - coalesce(sum(3 * source_size) OVER before, 0))::BIGINT AS rest,
         (sum(w) OVER after)::BIGINT AS rest_w
  FROM weighted
  WINDOW before AS (ORDER BY 3 * source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY 3 * source_size / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (
  SELECT arg_min(rest, (ratio, rest, rest_w)) AS rest, arg_min(rest_w, (ratio, rest, rest_w)) AS rest_w
  FROM shared WHERE 3 * source_size * rest_w > rest * w),
targets AS (
  SELECT s.source, s.source_size,
         CASE WHEN 3 * s.source_size * s.rest_w <= s.rest * s.w THEN (3 * s.source_size)::DOUBLE
              ELSE (l.rest * s.w) / l.rest_w END AS target
  FROM shared s LEFT JOIN level l ON true),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0::DOUBLE END AS rate FROM targets),
parts AS (SELECT *, floor(rate) AS whole, rate - floor(rate) AS part FROM rates),
steps AS (
  SELECT p.*, b.bin, b.words, sum(b.words) OVER (PARTITION BY b.source ORDER BY b.bin)::BIGINT AS so_far
  FROM bins b JOIN parts p ON b.source IS NOT DISTINCT FROM p.source),
met AS (
  SELECT source, arg_min(bin * 1048576 + CASE WHEN words > 0 THEN (part * source_size - (so_far - words)) / words ELSE 0.0::DOUBLE END * 1048576, bin) AS threshold
  FROM steps WHERE so_far >= part * source_size GROUP BY source),
mixed AS (
  SELECT d.doc_id, d.size, p.source_size, p.target,
         (p.whole + CASE WHEN d.draw < CASE WHEN p.part > 0 THEN coalesce(m.threshold, 4294967296.0::DOUBLE) ELSE 0.0::DOUBLE END THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN met m ON d.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM mixed
"""

_SQL_EXACT = r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS kept,
       text_sha256
FROM normal
"""

SQL: dict[str, str] = {"op1_mixing": _SQL_MIXING, "op4_exact_dedup": _SQL_EXACT}
