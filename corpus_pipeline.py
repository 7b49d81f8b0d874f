"""From raw documents to packed sequences, in stages over stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.llm import line_dedup, mixing, ngram_join, packing, quality
from curbflow.llm.common import apart, shared_folder, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    grades = quality.graded(table(spark, sf_dir, "labels"))
    model = quality.train_quality(docs, grades)
    return quality.kept_documents(docs, model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines of 20 words or more that occur earlier.

    ``n_chars`` follows the text.
    """

    def run(plain: DataFrame) -> DataFrame:
        changed = F.col("lines_removed") > 0
        n_chars = F.when(changed, F.length("text")).otherwise(F.col("n_chars"))
        return line_dedup.dedup_passages(plain).withColumn("n_chars", n_chars).select(*plain.columns)

    return apart(docs, run)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-copies."""
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of the permitted lengths."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

# The trained classifier and the shingle join have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
