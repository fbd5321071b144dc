"""Indexes of ledger tables, in parts: one for each data folder, as folders never change.

A part is made when the index is next read after a commit, so a commit costs a part and never a rebuild; parts of folders that the log no
longer names are not read, and erasing or compacting a table deletes them all. Parts hold versions, named by key, commit and validity; a
search joins them with the versions that are visible.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.operators import temporal, text, vectors
from chronoframe.operators.ledger import META, Ledger
from chronoframe.sources import paths

VERSION = ["commit_ts", "valid_from"]


def parts(table: Ledger, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """The index's rows over all folders of the table; None if it has none."""
    spark, found = table.spark, []
    for folder in table.store.folders(table.name):
        part = f"{table.path}/_index/{name}/{folder.rpartition('/')[2]}"
        if not paths.exists(spark, part):
            draft = f"{table.path}/_index/_drafts/{uuid.uuid4().hex}"
            make(spark.read.schema(table.schema).parquet(folder)).write.parquet(draft)
            if not paths.move(spark, draft, part):  # another reader made it meanwhile
                paths.delete(spark, draft)
        found.append(part)
    return spark.read.parquet(*found) if found else None


def now(table: Ledger) -> DataFrame:
    """(key, commit, validity) of the visible versions; other columns are not read."""
    return temporal.visible(table._stored().select(table.key, *META), key=table.key).select(table.key, *VERSION)


def postings(table: Ledger, name: str, columns: list[str]) -> DataFrame | None:
    """(key, version, stem, tf, n): a row per version and stem, and one with an empty stem per version; n is its length in tokens. Null columns are empty."""

    def make(rows: DataFrame) -> DataFrame:
        one = rows.dropDuplicates([table.key, *VERSION]).select(table.key, *VERSION, text.stems(F.concat_ws(" ", *columns)).alias("s"))
        each = one.select(table.key, *VERSION, F.size("s").alias("n"), F.explode(F.concat(F.array(F.lit("")), "s")).alias("stem"))
        return each.groupBy(table.key, *VERSION, "stem").agg(F.count("*").alias("tf"), F.first("n").alias("n")).sortWithinPartitions("stem")

    return parts(table, name, make)


def text_search(table: Ledger, name: str, columns: list[str], query: str) -> DataFrame:
    """(key, score): BM25 of the visible rows that hold a stem of the query, from the postings of those stems and the rows' lengths alone."""
    found = postings(table, name, columns)
    wanted = table.spark.range(1).select(F.array_distinct(text.stems(F.lit(query)))).first()[0]
    if found is None or not wanted:
        return table.read().select(table.key, F.lit(0.0).alias("score")).limit(0)
    held = found.where(F.col("stem").isin("", *wanted)).join(now(table), [table.key, *VERSION], "left_semi")
    counts = {r["stem"]: r for r in held.groupBy("stem").agg(F.count("*").alias("df"), F.avg("n").alias("mean")).collect()}  # a row per stem of the query
    if "" not in counts:
        return table.read().select(table.key, F.lit(0.0).alias("score")).limit(0)
    n_docs, mean = counts[""]["df"], counts[""]["mean"]
    score = F.lit(0.0)
    for s in wanted:
        df = counts[s]["df"] if s in counts else 0
        idf = F.log(F.lit(1 + (n_docs - df + 0.5) / (df + 0.5)))
        score = F.when(F.col("stem") == s, idf * F.col("tf") * (text.K1 + 1) / (F.col("tf") + text.K1 * (1 - text.B + text.B * F.col("n") / F.lit(mean)))).otherwise(score)
    return held.where("stem != ''").groupBy(table.key).agg(F.sum(score).alias("score"))


def cells(table: Ledger, name: str, column: str, centres: list[list[float]]) -> vectors.InvertedFile | None:
    """The inverted file over the visible rows; a version's cell is in its part."""
    index = vectors.InvertedFile.of(centres, table.key, column)
    found = parts(table, name, lambda rows: rows.dropDuplicates([table.key, *VERSION]).select(table.key, *VERSION, column, index.cell().alias("cell")).sortWithinPartitions("cell"))
    if found is None:
        return None
    index.rows = found.join(now(table), [table.key, *VERSION], "left_semi").drop(*VERSION)
    return index
