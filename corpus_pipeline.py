"""The corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymora.llm import decontaminate, line_dedup, lsh_forest, packing, quality
from kymora.llm.queries import VOCABULARY, table
from kymora.session import own_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier, learned from ``docs`` and the labels, rejects.

    Null and empty texts are judged by their length alone; repeated rows alike. No documents give no rows.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeated passages; a document of which nothing is left stays, with an empty text.

    Null texts stay null. A column ``deleted_bytes`` of the documents is dropped. No documents give no rows.
    """
    n_chars = F.when(F.col("deleted_bytes") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return line_dedup.dedup_lines(docs).withColumn("n_chars", n_chars).drop("deleted_bytes")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates; texts without words are one class. No documents give no rows."""
    return lsh_forest.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold benchmark passages; those without words stay. No documents or no items drop nothing."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences; a null text is its end token alone. No documents give no rows."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", repeated_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: the classifier and the tokenizer cannot be expressed.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stage on what the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = own_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
