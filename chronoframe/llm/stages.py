"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of ``docs``, whatever their names; columns that clash with an operator's own come through
unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, secret_scan
from . import packing as packer
from . import quality_rules as rules
from . import toxicity as tox
from ._shared import fold_of, table

POLICY = "v1"
#: Near duplicates: shingles of so many words, similarity in percent.
K, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents on which no rule of the policy fails stay."""
    rows = rules.ledger(docs.select("text", F.struct("*").alias("row")))
    return rules.apply_policy(rows, POLICY).select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half stay; the model learns from the labelled documents of the whole corpus."""
    corpus, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = tox.train(corpus, labels, fold_of(F.col("doc_id"), 5) != 0)
    rows = tox.scored(docs.select("text", F.struct("*").alias("row")), model, {"row": F.col("row")})
    return rows.where("predicted = 0").select("row.*")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents that with the smallest id stays (all rows of it, if ids repeat); texts without words and null ids stay."""
    groups = jaccard_join.ngram_jaccard_components(docs, K, PERCENT)
    gone = groups.where("doc_id != component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; live secrets in their texts are replaced by a mark."""
    return secret_scan.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packer.pieces(docs)
