"""From documents to packed sequences: rules, lines, near duplicates, benchmark, packing.

Every stage works on all documents that the one before kept; between stages the documents are
written once as Parquet to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import line_dedup, near_dup, packing, quality_rules, tiling
from plumbline.llm.queries import table, tokenizer_path
from plumbline.session import new_folder


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def recurring_lines_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_recurring_lines(docs)


def near_duplicates_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", good_quality),
    ("line dedup", recurring_lines_removed),
    ("near duplicates", near_duplicates_removed),
    ("decontamination", decontaminated),
    ("packing", packed),
]

# Signatures, tiles and token ids have no counterpart in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
