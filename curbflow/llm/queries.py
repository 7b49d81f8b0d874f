"""Queries of the operators over the given tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.llm import (
    divergence, embedding_dedup, html_extract, katz, line_dedup, mixing, ngram_join, packing,
    quality, spelling, suffix_dedup, topk, toxicity,
)
from curbflow.llm.common import table


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long"), topk.quantised(F.col("embedding")).alias("q")
    )
    return topk.top_inner_products(rows, rows.where("vec_id % 50 = 0"), 5)


OP1_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_links(table(spark, sf_dir, "documents")).drop("row")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).withColumn(
        "target", F.round("target", 6)
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.dedup_passages(docs).select("doc_id", "lines_removed", "text")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.grade_documents(docs, model)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents")).drop("row")


def _fold(n: int):
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract_pages(pages, html_extract.train_crf(pages))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents"), _fold(5) == 1)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(_fold(4) != 2)
    model = toxicity.train_toxicity(docs, labels)
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", (_fold(4) == 2).alias("held_out"), "score", "predicted"
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT CAST(e.vec_id AS BIGINT) AS vec_id, coalesce(n.n, 0) AS n_links,
       least(e.vec_id, coalesce(c.b, e.vec_id)) AS component_id,
       coalesce(e.vec_id = least(e.vec_id, coalesce(c.b, e.vec_id)), true) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": op1,
    "op2_ngram_jaccard_join": op2,
    "op3_html_extraction": op3,
    "op4_source_mixing": op4,
    "op5_line_dedup": op5,
    "op6_quality_classifier": op6,
    "op7_best_fit_packing": op7,
    "op8_katz_lm_scoring": op8,
    "op9_embedding_near_dedup": op9,
    "op10_toxicity": op10,
    "op11_source_divergence": op11,
    "op12_suffix_array_dedup": op12,
    "op13_spelling_variants": op13,
}

ORACLE: dict[str, str] = {
    "op1_exact_top_k": OP1_SQL,
    "op4_source_mixing": mixing.ORACLE,
    "op9_embedding_near_dedup": OP9_SQL,
    "op11_source_divergence": divergence.ORACLE,
    "op12_suffix_array_dedup": suffix_dedup.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
