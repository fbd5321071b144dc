"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

_BASE = "spark.checkpoint.dir"
#: Readers take 4,096 rows of a row group at once, and writers look at a row group's size after 100 rows first: too much where rows are long texts.
#: These groups end at so many bytes, looked at from the first row on.
_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is missing on a single machine (tests) a temporary folder is made and set; a cluster without it raises, as its
    executors could not read each other's files.
    """
    found = spark.conf.get(_BASE, None) or spark.sparkContext.getConf().get(_BASE)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"set {_BASE} to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="chronoframe-")
    atexit.register(_remove, made)
    spark.conf.set(_BASE, f"file://{made}")
    return f"file://{made}"


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the plan's lineage ends there.

    A lost executor costs no more than the tasks it ran, as the files outlive it. Row groups are small, so that a task holds few bytes of them
    however long the rows are.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "chronoframe", f"{name}-{uuid.uuid4().hex}")
    df.write.options(**_GROUPS).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def discard(*written: DataFrame) -> None:
    """Delete what ``cut`` wrote for these, once nothing that is still to be read comes from them."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Arrow batches of few rows for what is run inside; the session's own setting comes back after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def whole_ids(docs: DataFrame, name: str = "doc_id") -> Column:
    """The column of ids as long; ids that are no whole numbers raise, as a cast would make them null."""
    kind = docs.schema[name].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"{name} must hold whole numbers, not {kind.simpleString()}")
    return F.col(name).cast("long").alias(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)
