"""The registered queries of the corpus operators and their DuckDB text where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aisle.llm import (
    bpe, exact_dedup, language_id, line_dedup, mixing, ngram_join, periodic_runs, quality, sharding, simhash, substring_dedup, toxicity, whitening,
)
from aisle.llm.common import documents, table

TREE = sharding.even_tree(8)
GROWN = sharding.grown(TREE, 8)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labelled = mixing.labelled_domains(docs, table(spark, sf_dir, "labels"))
    return mixing.document_rates(docs, labelled, mixing.tempered(0.5, poor=0.25)).drop("body")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), TREE, GROWN)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(documents(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(documents(spark, sf_dir))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(documents(spark, sf_dir))


QUERIES = [
    op1_substring_dedup, op2_bpe, op3_quality_rules, op4_line_dedup, op5_mixing, op6_toxicity, op7_exact_dedup, op8_language_id, op9_sharding,
    op10_ngram_join, op11_whitening, op12_simhash, op13_periodic_runs,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": line_dedup.oracle(), "op7_exact_dedup": exact_dedup.ORACLE, "op9_sharding": sharding.oracle(TREE, GROWN)}
