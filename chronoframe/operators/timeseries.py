"""Time buckets, gap filling and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoframe.functions.scalar import epoch, interval_seconds


def time_bucket(interval: str, ts: Column) -> Column:
    """The start of the bucket of ``ts`` (epoch seconds or a timestamp's)."""
    n = interval_seconds(interval)
    return (F.floor(ts / n) * n).cast("long")


def downsample(df: DataFrame, interval: str, ts: str, value: str, *keys: str) -> DataFrame:
    """Per key and bucket: count, sum, avg, min, max, first_ts, last_ts."""
    t = epoch(F.col(ts))
    return df.groupBy(*keys, time_bucket(interval, t).alias("bucket")).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.min(t).alias("first_ts"), F.max(t).alias("last_ts")
    )


def gapfill(df: DataFrame, interval: str, bucket: str = "bucket", *keys: str) -> DataFrame:
    """A row for each bucket between a series' first and last; missing ones have null in all other columns."""
    n = interval_seconds(interval)
    ends = df.groupBy(*keys).agg(F.min(bucket).alias("_a"), F.max(bucket).alias("_b"))
    grid = ends.select(*keys, F.explode(F.sequence("_a", "_b", F.lit(n).cast("long"))).alias(bucket))
    return grid.join(df, [*keys, bucket], "left")


def _before(keys: tuple[str, ...], by: str):
    return W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, 0)


def locf(df: DataFrame, column: str, by: str, *keys: str) -> DataFrame:
    """Nulls take the last value before them."""
    return df.withColumn(column, F.last(column, ignorenulls=True).over(_before(keys, by)))


def interpolate(df: DataFrame, column: str, by: str, *keys: str) -> DataFrame:
    """Nulls between two values lie on the line between these; before the first and after the last they stay."""
    point = F.when(F.col(column).isNotNull(), F.struct(F.col(by).alias("t"), F.col(column).alias("v")))
    after = W.partitionBy(*keys).orderBy(by).rowsBetween(0, W.unboundedFollowing)
    rows = df.withColumn("_p", F.last(point, ignorenulls=True).over(_before(keys, by))).withColumn("_n", F.first(point, ignorenulls=True).over(after))
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col(by) - F.col("_p.t")) / F.nullif(F.col("_n.t") - F.col("_p.t"), F.lit(0))
    return rows.withColumn(column, F.coalesce(column, line)).drop("_p", "_n")


def delta(df: DataFrame, column: str, by: str, *keys: str) -> DataFrame:
    return df.withColumn("delta", F.col(column) - F.lag(column).over(W.partitionBy(*keys).orderBy(by)))


def rate(df: DataFrame, column: str, by: str, *keys: str) -> DataFrame:
    """Change per unit of ``by``; null for the first row and where ``by`` stands still."""
    w = W.partitionBy(*keys).orderBy(by)
    return df.withColumn("rate", (F.col(column) - F.lag(column).over(w)) / F.nullif(F.col(by) - F.lag(by).over(w), F.lit(0)))


def bucket_range(df: DataFrame, low: int, high: int, bucket: str = "bucket") -> DataFrame:
    """Buckets from ``low`` to ``high``, both included."""
    return df.where(F.col(bucket).between(low, high))
