"""Registered queries of the corpus operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nightgrid.llm import alignment, bitpack, ctw, decontaminate, divergence, jaccard, packing, quality, repeats, rules, toxicity, web_queries
from nightgrid.llm.text import crc_mod
from nightgrid.llm.tokens import vocab_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(web_queries.QUERIES)
ORACLES: dict[str, str] = dict(web_queries.ORACLES)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).drop("pattern")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) == 2)


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) == 1)


@query
def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(packing.pieces(table(spark, sf_dir, "documents"), vocab_path()))


@query
def op10_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.id_files(table(spark, sf_dir, "documents"), vocab_path())


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), vocab_path(), vocab_path("piece_bpe_32k.model"))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


ORACLES["op12_source_divergence"] = divergence.ORACLE


@query
def op13_repeat_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut_repeats(table(spark, sf_dir, "documents")).drop("kept")
