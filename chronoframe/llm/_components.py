"""Connected components by alternating large-star and small-star steps, entirely in joins and aggregates.

Each step points nodes at the smallest neighbour; the rounds needed grow with the logarithm of the longest path. The
smallest neighbour comes from a partial aggregate and is joined back, so a node with very many neighbours is never
gathered in one task (adaptive execution splits its side of the join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, discard


def _with_least(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    side = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return side.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node points at one node at most, and none that is pointed at points on: then ``v`` is the component of ``u``."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("from"), F.lit(0).alias("to")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("from").alias("from"), F.max("to").alias("to")).where("from + to > 1").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of the undirected ``edges``; the component is its smallest node.

    It reads the last round's files, which ``discard`` removes.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    while not _stars(now):
        last, now = now, cut(_small_star(_large_star(now)), "edges")
        discard(last)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    out._written_to = now._written_to
    return out
