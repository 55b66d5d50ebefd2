"""Corpus pipeline over the documents table.

Five stages, each written as Parquet and read again: quality classifier,
quality rules, one document of each near-duplicate group, benchmark
decontamination, best-fit packing.  All but the last return the columns of
documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nightgrid.llm import decontaminate, jaccard, packing, quality, rules
from nightgrid.llm.storage import stored
from nightgrid.llm.text import crc_mod
from nightgrid.llm.tokens import vocab_path

#: The rules depend on a fit, and token ids on a vocabulary file: SQL can express neither.
ORACLE_SQL = None


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores a half or more; it learns from the labelled folds of its query."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_quality(docs, quality.fit_quality(docs, labels, crc_mod("doc_id", 3) != 1))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted rules keep."""
    return rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked texts."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a twentieth of their words in benchmark windows."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences of 1024."""
    return packing.pack_sequences(packing.pieces(docs, vocab_path()))


STAGES = [
    ("quality_classifier", classify_quality),
    ("quality_rules", apply_rules),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
