"""Risk scores, tags and clusters of change texts, by keyword."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values. Spellings that count, and their weight in the quick score.
QUICK = [
    (("error", "Error", "ERROR"), 0.30), (("failed", "Failed", "FAILED"), 0.25), (("critical", "Critical", "CRITICAL"), 0.35),
    (("unauthorized", "Unauthorized"), 0.40), (("timeout", "Timeout"), 0.20), (("panic", "PANIC"), 0.40),
]
#: Fixed values. Tags, and the words of which any gives the tag.
TAGS = {
    "operational-error": ("error", "failed", "exception"), "payments-risk": ("refund", "chargeback", "dispute"), "performance": ("latency", "timeout", "slow"),
    "capacity-signal": ("cpu", "memory", "disk"), "security": ("login", "password", "token"),
}
SIGNALS = {"release-signal": ("deploy", "release"), "connectivity": ("connection", "reset", "upstream"), "backpressure": ("queue", "backlog", "throttle")}
BASE, LONG, LONG_BYTES = 0.15, 0.10, 240
TAG_RISK = {"operational-error": 0.25, "payments-risk": 0.25, "security": 0.30}
WINDOW_MS = 60_000


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def quick_score(text: Column) -> Column:
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, (F.when(_any(text, words), weight).otherwise(0.0) for words, weight in QUICK)))


def tags(text: Column) -> Column:
    """Sorted distinct tags; ``general-observation`` where no word of TAGS occurs."""
    low = F.lower(text)
    own = F.array_compact(F.array(*(F.when(_any(low, words), tag) for tag, words in TAGS.items())))
    more = F.array_compact(F.array(*(F.when(_any(low, words), tag) for tag, words in SIGNALS.items())))
    return F.array_sort(F.concat(F.when(F.size(own) == 0, F.array(F.lit("general-observation"))).otherwise(own), more))


def score(text: Column) -> Column:
    low = F.lower(text)
    parts = [F.lit(BASE), F.when(F.octet_length(text) > LONG_BYTES, LONG).otherwise(0.0)]
    parts += [F.when(_any(low, TAGS[tag]), weight).otherwise(0.0) for tag, weight in TAG_RISK.items()]
    parts += [F.when(_any(low, ("degraded", "outage")), 0.15).otherwise(0.0), F.when(F.contains(low, F.lit("retry")) & F.contains(low, F.lit("failed")), 0.10).otherwise(0.0)]
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, parts))


def severity(risk: Column) -> Column:
    return F.when(risk >= 0.75, "critical").when(risk >= 0.45, "elevated").otherwise("normal")


def insights(changes: DataFrame, text: str, at_ms: str) -> DataFrame:
    """``changes`` with tags, risk_score and cluster_id: time window, severity and a hash of both with the tags."""
    out = changes.withColumns({"tags": tags(F.col(text)), "risk_score": F.round(score(F.col(text)), 6)})
    window = F.floor(F.col(at_ms) / WINDOW_MS).cast("long")
    sign = F.concat_ws("|", window.cast("string"), severity(F.col("risk_score")), F.array_join("tags", ","))
    return out.withColumn("cluster_id", F.concat_ws("-", F.lpad(window.cast("string"), 10, "0"), severity(F.col("risk_score")), F.left(F.md5(sign), F.lit(16))))


def cluster_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cluster_id").agg(F.count("*").alias("n"), F.round(F.avg("risk_score"), 6).alias("mean_risk"), F.max("risk_score").alias("top_risk"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))), ",").alias("tags"))


def top_risks(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    return rows.orderBy(F.desc("risk_score"), key).limit(n)


@F.pandas_udf(T.StringType())
def flatten_json(docs: pd.Series) -> pd.Series:
    """``path=value`` of every leaf of a JSON text, sorted by path and joined by spaces; other text as it is."""

    def leaves(path: str, value: object) -> list[str]:
        if isinstance(value, dict):
            return [x for k in sorted(value) for x in leaves(f"{path}.{k}" if path else k, value[k])]
        if isinstance(value, list):
            return [x for i, v in enumerate(value) for x in leaves(f"{path}[{i}]", v)]
        return [f"{path}={json.dumps(value) if not isinstance(value, str) else value}"]

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else " ".join(leaves("", json.loads(text)))
        except ValueError:
            return text

    return docs.map(one)
