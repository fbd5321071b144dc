"""Bitemporal visibility over ledgers: (pk, ..., commit_ts, valid_from, valid_to, is_deleted).

A version is known from its ``commit_ts`` until a newer one of its key, and true from ``valid_from`` until ``valid_to``
(exclusive). Picking the newest is a partial aggregate (``max_by``), so a key's history is folded before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FOREVER = 2**63 - 1


def visible(ledger: DataFrame, as_of: int | None = None, valid_at: int | None = None, key: str = "pk") -> DataFrame:
    """The newest version of each key among those known at ``as_of`` and true at ``valid_at``; deleted keys are left out after the pick."""
    rows = ledger
    if as_of is not None:
        rows = rows.where(F.col("commit_ts") <= as_of)
    if valid_at is not None:
        rows = rows.where((F.col("valid_from") <= valid_at) & (F.col("valid_to") > valid_at))
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct("commit_ts", "valid_from")).alias("v"))
    return newest.select("v.*").where("NOT is_deleted")


def as_of_epoch(ledger: DataFrame, commits: DataFrame, epoch: int, valid_at: int | None = None) -> DataFrame:
    """As of a commit epoch: ``commits`` maps epoch to commit_ts; an epoch that it lacks is itself the timestamp."""
    found = commits.where(F.col("epoch") == epoch).agg(F.max("commit_ts")).first()[0]
    return visible(ledger, found if found is not None else epoch, valid_at)


def known(ledger: DataFrame, key: str = "pk") -> DataFrame:
    """All versions with ``known_to``, when the next version of the key came."""
    return ledger.withColumn("known_to", F.coalesce(F.lead("commit_ts").over(W.partitionBy(key).orderBy("commit_ts", "valid_from")), F.lit(FOREVER)))


def system_time(ledger: DataFrame, start: int, end: int, closed: bool = False, key: str = "pk") -> DataFrame:
    """Versions known at some time from ``start`` to ``end`` (inclusive if ``closed``)."""
    before = F.col("commit_ts") <= end if closed else F.col("commit_ts") < end
    return known(ledger, key).where(before & (F.col("known_to") > start)).drop("known_to")


def application_time(ledger: DataFrame, start: int, end: int, closed: bool = False) -> DataFrame:
    """Versions true at some time from ``start`` to ``end`` (inclusive if ``closed``)."""
    before = F.col("valid_from") <= end if closed else F.col("valid_from") < end
    return ledger.where(before & (F.col("valid_to") > start))


def temporal_join(left: DataFrame, right: DataFrame, on: str, as_of: int | None = None, valid_at: int | None = None) -> DataFrame:
    """Both sides as visible at the same times, joined."""
    return visible(left, as_of, valid_at).join(visible(right, as_of, valid_at).drop("commit_ts", "valid_from", "valid_to", "is_deleted"), on)


#: A key's time is cut into so many equal ranges, so that a hot key is the work of many tasks.
RANGES = 64


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str, out: str) -> DataFrame:
    """For each left row the ``value`` of the right side's last row of the key up to the left time (the largest of equal times); null before the first.

    Both sides are unioned and carried forward in one window per key and range of time, so rows are sorted once and never paired. What a range
    begins with is the last value of the ranges before it: at most RANGES rows a key, found by a partial aggregate. A null left time finds nothing, a
    null right time is never found.
    """

    def number(df: DataFrame, ts: str) -> Column:
        kind = df.schema[ts].dataType.simpleString()
        return F.unix_micros(F.col(ts).cast("timestamp")).cast("double") if kind in ("timestamp", "timestamp_ntz", "date") else F.col(ts).cast("double")

    low, high = right.agg(F.min(number(right, right_ts)), F.max(number(right, right_ts))).first()
    width = ((high or 0.0) - (low or 0.0)) / RANGES or 1.0

    def part(df: DataFrame, ts: str) -> Column:
        return F.least(F.greatest(F.floor((number(df, ts) - F.lit(low or 0.0)) / F.lit(width)), F.lit(0)), F.lit(RANGES)).cast("int").alias("_b")

    rows = left.select("*", F.col(left_ts).alias("_t"), F.lit(1).alias("_s"), part(left, left_ts))
    seen = right.where(F.col(right_ts).isNotNull()).select(F.col(key), F.col(right_ts).alias("_t"), F.lit(0).alias("_s"), part(right, right_ts), F.struct(value).alias("_v"))
    w = W.partitionBy(key, "_b").orderBy("_t", "_s", "_v").rowsBetween(W.unboundedPreceding, 0)
    both = rows.unionByName(seen, allowMissingColumns=True).withColumn("_l", F.last("_v", ignorenulls=True).over(w)).where("_s = 1")
    lasts = rows.select(key, "_b").distinct().unionByName(seen.groupBy(key, "_b").agg(F.max(F.struct("_t", "_v")).alias("_m")), allowMissingColumns=True).groupBy(key, "_b").agg(F.max("_m").alias("_m"))
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = lasts.select(F.col(key).alias("_k"), F.col("_b").alias("_c"), F.last("_m", ignorenulls=True).over(before)["_v"].alias("_f"))
    full = both.join(carried, both[key].eqNullSafe(carried["_k"]) & (both["_b"] == carried["_c"]), "left")
    return full.withColumn(out, F.when(F.col("_t").isNotNull(), F.coalesce("_l", "_f")[value])).drop("_t", "_s", "_b", "_v", "_l", "_k", "_c", "_f")
