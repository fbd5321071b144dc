"""Vector distances, exact and clustered nearest neighbours, quantization, and score fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclidean(a: Column, b: Column) -> Column:
    """Null if the lengths differ."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def cosine_similarity(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(size < 1e-10, 0.0).otherwise(dot(a, b) / size))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def negative_dot(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), -dot(a, b))


METRICS = {"euclidean": euclidean, "cosine": cosine_distance, "dot": negative_dot}


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def search(df: DataFrame, key: str, column: str, query: list[float], k: int = 10, metric: str = "cosine") -> DataFrame:
    """(key, distance, score, rank) of the ``k`` nearest: each task keeps its own k before they meet."""
    near = df.select(key, METRICS[metric](F.col(column), literal(query)).alias("distance")).where("distance is not null").orderBy("distance", key).limit(k)
    return near.select(key, "distance", (1 / (1 + F.col("distance"))).alias("score"), F.row_number().over(W.orderBy("distance", key)).alias("rank"))


def knn(df: DataFrame, key: str, column: str, queries: dict[int, list[float]], k: int = 10, metric: str = "euclidean") -> DataFrame:
    """The ``k`` nearest for each stated query: (query, key, distance, rank).

    Queries are literals in the plan. Each row is measured against them in place, and a partial top-k per task and query comes before the shuffle.
    """
    measured = F.array(*(F.struct(F.lit(q).alias("query"), METRICS[metric](F.col(column), literal(v)).alias("distance")) for q, v in queries.items()))
    rows = df.select(key, F.inline(measured)).where("distance is not null").withColumn("task", F.spark_partition_id())
    own = rows.withColumn("r", F.row_number().over(W.partitionBy("query", "task").orderBy("distance", key))).where(F.col("r") <= k)
    ranked = own.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("distance", key)))
    return ranked.where(F.col("rank") <= k).select("query", key, "distance", "rank")


def nearest_centres(centres: list[np.ndarray], column: Column, n: int = 1, whole: bool = True) -> Column:
    """Per piece of a vector the numbers of the ``n`` nearest of that piece's centres, by Euclidean distance and then by number, one piece after another.

    Pieces as wide as their centres follow each other; ``whole`` vectors have no more numbers than that. The first n stand for a piece that has no distance.
    """
    ends = np.cumsum([c.shape[1] for c in centres]).tolist()

    def near(vectors: pa.Array) -> pa.Array:
        sizes, flat = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(), vectors.flatten()
        even = len(vectors) > 0 and (sizes == sizes[0]).all() and sizes[0] >= ends[-1] and not flat.null_count
        rows = flat.to_numpy().reshape(len(vectors), sizes[0]) if even else vectors.to_pylist()
        out = []
        for c, end in zip(centres, ends):
            begin = end - c.shape[1]
            fits = np.ones(len(rows), bool) if even else [v is not None and len(v) >= end and None not in v[begin:end] for v in rows]
            fits = np.array(fits, bool) & ((sizes == ends[-1]) | (not whole))
            x = rows[:, begin:end] if even else np.array([v[begin:end] if f else [0.0] * len(c[0]) for v, f in zip(rows, fits)], float).reshape(len(rows), end - begin)
            d = np.zeros((len(x), len(c)))
            with np.errstate(all="ignore"):
                for i in range(end - begin):
                    d += (x[:, i, None] - c[None, :, i]) ** 2
                order = np.sqrt(d).argsort(axis=1, kind="stable")
            out.append(np.where(fits[:, None], order, np.arange(len(c)))[:, :n])
        found = np.concatenate(out, axis=1)
        return pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], pa.array(found.ravel(), pa.int32()))

    return F.arrow_udf(near, T.ArrayType(T.IntegerType()))(column.cast("array<double>"))


class InvertedFile:
    """Clustered search: k-means cells over a bounded sample; a query looks at the ``probes`` nearest cells only."""

    def __init__(self, df: DataFrame, key: str, column: str, cells: int = 16, sample_rows: int = 10_000, seed: int = 7):
        sample = np.array([r[0] for r in df.select(column).orderBy(F.xxhash64(key)).limit(sample_rows).collect()], float)
        random = np.random.default_rng(seed)
        centres = sample[random.choice(len(sample), min(cells, len(sample)), replace=False)]
        for _ in range(10):
            cell = ((sample[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([sample[cell == i].mean(0) if (cell == i).any() else c for i, c in enumerate(centres)])
        self.centres, self.key, self.column = centres, key, column
        self.rows = df.withColumn("cell", self.cell())

    @classmethod
    def of(cls, centres: list[list[float]], key: str, column: str) -> InvertedFile:
        """With centres learnt before; ``rows``, which have a column ``cell``, are the caller's to give."""
        made = cls.__new__(cls)
        made.centres, made.key, made.column, made.rows = np.array(centres, float), key, column, None
        return made

    def cell(self) -> Column:
        """The number of a vector's nearest centre."""
        return F.get(nearest_centres([self.centres], F.col(self.column)), 0)

    def search(self, query: list[float], k: int = 10, probes: int = 4, metric: str = "euclidean") -> DataFrame:
        order = ((self.centres - np.array(query)) ** 2).sum(1).argsort()[:probes]
        return search(self.rows.where(F.col("cell").isin(order.tolist())), self.key, self.column, query, k, metric)

    def _asked(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query, asked, cells): the vectors asked for, and the ``probes`` cells nearest to each."""
        return queries.select(F.col(self.key).alias("query"), F.col(self.column).alias("asked"), nearest_centres([self.centres], F.col(self.column), probes).alias("cells"))

    def search_all(self, queries: DataFrame, k: int = 10, probes: int = 4, metric: str = "euclidean") -> DataFrame:
        """(query, key, distance, rank) for each row of ``queries``, which has the index's columns."""
        return nearest_in_cells(self.rows.select(self.key, "cell", self.column), self._asked(queries, probes), k, metric)

    def search_codes(self, queries: DataFrame, quantizer: "ProductQuantizer", k: int = 10, probes: int = 4, candidates: int = 100) -> DataFrame:
        """(query, key, distance, rank): the nearest ``candidates`` by codes in the probed cells, ranked again by their Euclidean distance."""
        coded = self.rows.select(self.key, "cell", quantizer.decode(quantizer.encode(F.col(self.column))).alias(self.column))
        some = nearest_in_cells(coded, self._asked(queries, probes), candidates).select("query", self.key)
        vectors = queries.select(F.col(self.key).alias("query"), F.col(self.column).alias("asked"))
        found = some.join(self.rows.select(self.key, self.column), self.key).join(vectors, "query").select("query", self.key, euclidean(F.col(self.column), F.col("asked")).alias("distance"))
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("distance", self.key)))
        return ranked.where(F.col("rank") <= k)


#: Most rows and queries of a block of ``nearest_in_cells``, fewest blocks, and most numbers of a matrix of distances.
BLOCK_ROWS, BLOCK_QUERIES, BLOCKS, MATRIX = 65_536, 16_384, 32, 1 << 22


def nearest_in_cells(rows: DataFrame, asked: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """(query, key, distance, rank): for each query the ``k`` nearest of the rows in its cells, from ``rows`` (key, cell, vector) and ``asked`` (query, asked, cells).

    All pairs are measured, as matrices: rows and queries are dealt over blocks by the hash of their keys, each block of rows meets each block of queries
    in a task of bounded memory, and ``k`` of each block of rows are left for a query.
    """
    key, _, column = rows.columns
    rows, asked = (df.withColumn(c, F.col(c).cast("array<double>")).where(F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull())) for df, c in ((rows, column), (asked, "asked")))
    parts = max(BLOCKS, -(-rows.select(key).count() // BLOCK_ROWS))
    turns = max(1, -(-asked.select("query").count() // BLOCK_QUERIES))

    def dealt(df: DataFrame, by: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumns({own: F.pmod(F.xxhash64(by), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})

    held = dealt(rows, key, "_part", parts, "_turn", turns).groupBy("_part", "_turn")
    wanted = dealt(asked, "query", "_turn", turns, "_part", parts).groupBy("_part", "_turn")
    types = T.StructType([T.StructField("query", asked.schema["query"].dataType), T.StructField(key, rows.schema[key].dataType), T.StructField("distance", T.DoubleType())])
    out = to_arrow_schema(types)

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        return _block(a.select([key, "cell", column]), b.select(["query", "asked", "cells"]), k, metric, out)

    found = held.cogroup(wanted).applyInArrow(block, types)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("distance", key)))
    return ranked.where(F.col("rank") <= k)


def _block(rows: pa.Table, asked: pa.Table, k: int, metric: str, out: pa.Schema) -> pa.Table:
    """The ``k`` nearest rows of a block for each query; a row's place stands for its key, so that equal distances are in the order of keys."""
    found = [out.empty_table()]
    if rows.num_rows and asked.num_rows:
        rows = rows.take(pc.sort_indices(rows.column(0), null_placement="at_start")).combine_chunks()
        sizes, wanted = (pc.list_value_length(t.column(i)).to_numpy() for t, i in ((rows, 2), (asked, 1)))
        probes = pc.list_value_length(asked.column(2)).to_numpy()
        owner, cell_of = np.repeat(np.arange(len(probes)), probes), pc.list_flatten(asked.column(2)).to_numpy()
        cells = rows.column(1).to_numpy()
        for size in np.intersect1d(sizes, wanted):
            for cell in np.unique(cells[sizes == size]):
                r = np.flatnonzero((sizes == size) & (cells == cell))
                q = np.intersect1d(owner[cell_of == cell], np.flatnonzero(wanted == size))
                if len(q):
                    x, y = (pc.list_flatten(t.column(i).take(pa.array(at))).to_numpy().reshape(len(at), size) for t, i, at in ((asked, 1, q), (rows, 2, r)))
                    i, j, d = _nearest(x, y, k, metric)
                    found.append(pa.Table.from_arrays([asked.column(0).take(pa.array(q[i])), rows.column(0).take(pa.array(r[j])), pa.array(d)], schema=out))
    return pa.concat_tables(found)


def _nearest(x: np.ndarray, y: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``x`` and ``y`` and distances of the ``k`` rows of ``y`` nearest to each row of ``x``; of equal ones the first.

    Euclidean distances are first had from products, with a bound of their error; only rows that may be among the k by it are measured as elsewhere.
    """
    step, size = max(1, MATRIX // len(y)), x.shape[1]
    with np.errstate(all="ignore"):
        x2, y2 = (x * x).sum(1), (y * y).sum(1)
        quick = metric == "euclidean" and np.isfinite(x2.max() + y2.max()) and len(y) > k
        out = []
        for at in range(0, len(x), step):
            some = x[at : at + step]
            if quick:
                rough = y2 - 2 * (some @ y.T)
                error = 4 * (size + 8) * np.finfo(float).eps * (x2[at : at + step] + y2.max())
                i, j = np.nonzero(rough <= (np.partition(rough, k - 1, axis=1)[:, k - 1] + error)[:, None])
            else:
                i, j = (a.ravel() for a in np.indices((len(some), len(y))))
            d = np.concatenate([_exact(some[i[p : p + 65_536]], y[j[p : p + 65_536]], metric) for p in range(0, len(i), 65_536)])
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((i[first] + at, j[first], d[first]))
    return tuple(np.concatenate(a) for a in zip(*out))


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows to rows, summed in the order of the components, as the columns' functions do."""

    def summed(terms: np.ndarray) -> np.ndarray:
        out = np.zeros(len(terms))
        for i in range(terms.shape[1]):
            out += terms[:, i]
        return out

    if metric == "euclidean":
        return np.sqrt(summed((a - b) * (a - b)))
    if metric == "dot":
        return -summed(a * b)
    size = np.sqrt(summed(a * a)) * np.sqrt(summed(b * b))
    return 1 - np.where(size < 1e-10, 0.0, summed(a * b) / size)


def quantize_int8(a: Column) -> Column:
    """(scale, codes): codes are the components by the largest absolute value, times 127."""
    scale = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    codes = F.transform(a, lambda x: F.when(scale == 0, F.lit(0)).otherwise(F.round(x.cast("double") / scale * 127)).cast("byte"))
    return F.struct(scale.alias("scale"), codes.alias("codes"))


def dequantize_int8(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: c.cast("double") / 127 * q["scale"])


def hybrid_score(distance: Column, text: Column, vector_weight: float, text_weight: float) -> Column:
    return F.lit(vector_weight) / (1 + distance) + F.lit(text_weight) * text


def reciprocal_rank_fusion(a: DataFrame, b: DataFrame, key: str, k: float = 60.0) -> DataFrame:
    """(key, score) from two lists with ``rank``."""
    both = a.select(key, "rank").unionAll(b.select(key, "rank"))
    return both.groupBy(key).agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def weighted_fusion(vectors: DataFrame, texts: DataFrame, key: str, vector_weight: float, text_weight: float) -> DataFrame:
    """(key, score) from ``distance`` and ``score``, each scaled to 0-1 over its list, distances turned round; absent ones count 0."""

    def scaled(df: DataFrame, column: str) -> DataFrame:
        low, high = df.agg(F.min(column), F.max(column)).first()
        span = (high - low) if low is not None and high > low else None
        return df.select(key, (F.lit(1.0) if span is None else (F.col(column) - F.lit(low)) / F.lit(span)).alias("x"))

    near = scaled(vectors, "distance").select(key, ((F.lit(1.0) - F.col("x")) * vector_weight).alias("part"))
    if vectors.select("distance").distinct().limit(2).count() < 2:
        near = vectors.select(key, F.lit(vector_weight).alias("part"))
    far = scaled(texts, "score").select(key, (F.col("x") * text_weight).alias("part"))
    return near.unionAll(far).groupBy(key).agg(F.sum("part").alias("score"))


def temporal_search(df: DataFrame, key: str, column: str, query: list[float], at: int | None, k: int = 10, metric: str = "cosine") -> DataFrame:
    """Nearest among the rows valid at ``at``; without a time, among those still valid."""
    now = F.col("valid_to") == 2**63 - 1 if at is None else (F.col("valid_from") <= at) & (F.col("valid_to") > at)
    return search(df.where(now), key, column, query, k, metric)


def round_to_f16(a: Column) -> Column:
    """Vectors as they come back from half precision: 11 bits, to even on ties; beyond its range infinite."""

    def half(x: Column) -> Column:
        x = x.cast("double")
        step = F.pow(F.lit(2.0), F.greatest(F.when(x == 0, F.lit(-14.0)).otherwise(F.floor(F.log2(F.abs(x))).cast("double")), F.lit(-14.0)) - 10)
        out = F.rint(x / step) * step
        return F.when(F.abs(out) >= 65520, F.signum(x) * F.lit(float("inf"))).otherwise(out).cast("float")

    return F.transform(a, half)


class ProductQuantizer:
    """Vectors cut into ``parts`` equal pieces, each stored as the number of its nearest of ``codes`` centres, learnt from a bounded sample."""

    def __init__(self, df: DataFrame, key: str, column: str, parts: int = 8, codes: int = 16, sample_rows: int = 5_000, seed: int = 7):
        sample = np.array([r[0] for r in df.select(column).orderBy(F.xxhash64(key)).limit(sample_rows).collect()], float)
        if sample.shape[1] % parts:
            raise ValueError("parts must divide the dimensions")
        self.width, self.parts, self.centres = sample.shape[1] // parts, parts, []
        random = np.random.default_rng(seed)
        for p in range(parts):
            x = sample[:, p * self.width : (p + 1) * self.width]
            c = x[random.choice(len(x), min(codes, len(x)), replace=False)]
            for _ in range(10):
                near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
                c = np.array([x[near == i].mean(0) if (near == i).any() else o for i, o in enumerate(c)])
            self.centres.append(c)

    def encode(self, column: Column) -> Column:
        """The codes of a vector column."""
        return nearest_centres(self.centres, column, whole=False)

    def decode(self, codes: Column) -> Column:
        tables = [F.array(*(literal(x) for x in c.tolist())) for c in self.centres]
        return F.flatten(F.array(*(F.get(t, F.get(codes, p)) for p, t in enumerate(tables))))

    def distance(self, codes: Column, query: list[float]) -> Column:
        """The Euclidean distance of coded vectors to a query, from a table of its distances to all centres."""
        q = np.array(query).reshape(self.parts, self.width)
        sums = [F.get(literal(((c - q[p]) ** 2).sum(1).tolist()), F.get(codes, p)) for p, c in enumerate(self.centres)]
        return F.sqrt(sum(sums[1:], sums[0]))
