"""The driver queries of the ten operators, each a thin digest of its operator's output over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bm25_search, jaccard_join, language_model, packing, piece_encoding, quality_model, quality_rules, secret_scan, toxicity, url_filter
from veilframe.llm.common import held_out, table

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage whose id is divisible by 20, searched in all documents."""
    return bm25_search.search(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "benchmark").where("item_id % 20 = 0"))


def op1_document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20, its whole text searched in all documents; op1_bm25_search keeps the queries of its SQL."""
    docs = table(spark, sf_dir, "documents", spread=True)
    return bm25_search.search(docs, docs.where("doc_id % 20 = 0"), query_key="doc_id")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_scan(table(spark, sf_dir, "documents", spread=True)))


def predicted(scores: DataFrame, modulus: int, remainder: int, threshold: float) -> DataFrame:
    return scores.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4, 2))
    return predicted(toxicity.toxicity(docs, model), 4, 2, toxicity.THRESHOLD)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents", spread=True))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.lm_scores(table(spark, sf_dir, "documents", spread=True), held_out(F.col("doc_id"), 7, 2))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents", spread=True))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True)
    model = quality_model.train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0))
    return predicted(quality_model.quality_scores(docs, model), 5, 0, quality_model.THRESHOLD)


def op8_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoding.digests(table(spark, sf_dir, "documents", spread=True), public_tokenizers.path("piece_bpe_32k.model"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages", spread=True), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents", spread=True)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bm25_search, op1_document_search, op2_secret_scan, op3_toxicity, op4_packing, op5_language_model, op6_jaccard_join, op7_quality_classifier, op8_piece_encoding, op9_url_filter, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op1_bm25_search": bm25_search.SQL, "op6_jaccard_join": jaccard_join.SQL, "op10_quality_rules": quality_rules.duckdb_sql()}
