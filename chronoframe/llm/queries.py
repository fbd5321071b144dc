"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, license_scan, media, packing, pieces, quality_classifier, quality_rules, secret_scan, toxicity, url_filter
from ._shared import fold_of, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).withColumn("score", F.round("score"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.ngram_jaccard_components(table(spark, sf_dir, "documents"), 3, 90)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, fold_of(F.col("doc_id"), 5) != 0)
    return toxicity.scored(docs, model, {"doc_id": F.col("doc_id"), "held_out": fold_of(F.col("doc_id"), 5) == 0})


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *measures, (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("v1").alias("kept"), "failures")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels, fold_of(F.col("doc_id"), 3) != 1)
    return quality_classifier.scored(docs, model, {"doc_id": F.col("doc_id"), "held_out": fold_of(F.col("doc_id"), 3) == 1})


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_media_columns": op3_media_columns,
    "op4_packing": op4_packing,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_toxicity": op6_toxicity,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_license_scan": op10_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": url_filter.SQL,
    "op2_ngram_jaccard_join": jaccard_join.SQL,
    "op7_secret_scan": secret_scan.SQL,
    "op8_quality_rules": quality_rules.SQL,
    "op10_license_scan": license_scan.SQL,
}
