"""Labelled rows for models, and the scoring of whole tables by a model that every task holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[slice, list[bytes]]]:
    """The texts of a batch as UTF-8, in runs of few bytes; a null is empty."""
    sizes = np.cumsum(pc.binary_length(texts.cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield slice(at, end), [t or b"" for t in texts[at:end].cast(pa.binary()).to_pylist()]
        at = end


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """(text, y) of at most ``most`` labelled rows that ``learn`` allows, by a hash of their ids; so small that it is broadcast."""
    chosen = labels.where(learn & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")


def score(docs: DataFrame, keep: dict[str, Column], rate: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """The columns ``keep`` and ``score`` of each row; ``rate`` maps texts to scores."""
    given = docs.select(*(c.alias(n) for n, c in keep.items()), F.col("text").cast("string").alias("text"))
    out = given.drop("text").withColumn("score", F.lit(0.0)).schema
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch.column("text")):
                cols = [batch.column(n)[part] for n in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(rate(texts), pa.float64())], names=[*names, "score"])

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return given.mapInArrow(run, out)
