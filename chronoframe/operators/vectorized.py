"""The batch operators of the library surface, as DataFrame compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join without the right key; right columns whose names clash get ``__right``."""
    names = {c: f"{c}__right" if c in left.columns else c for c in right.columns}
    renamed = right.select(F.col(right_key).alias("_k"), *(F.col(c).alias(n) for c, n in names.items() if c != right_key))
    return left.join(renamed, left[left_key] == F.col("_k")).drop("_k")


def hash_aggregate(df: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str]]) -> DataFrame:
    """``aggregates``: output name -> (function, column)."""
    return df.groupBy(*keys).agg(*(F.expr(f"{f}({c})").alias(n) for n, (f, c) in aggregates.items()))


def sort_nulls_last(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*(F.col(c).asc_nulls_last() for c in columns))
