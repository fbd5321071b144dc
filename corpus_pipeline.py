"""The corpus pipeline: stages over ``documents``, each written as Parquet and read back as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoframe.llm import stages
from chronoframe.llm._shared import cut, table

STAGES = [
    ("quality rules", stages.quality_rules),
    ("toxicity", stages.toxicity),
    ("n-gram Jaccard join", stages.ngram_jaccard_join),
    ("secret scans", stages.secret_scans),
    ("packing", stages.packing),
]

#: The toxicity stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
