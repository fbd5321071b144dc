"""Toxicity: a factorization machine over hashed terms.

A text's terms are its words (A-Z lower-cased runs of digits, letters and non-ASCII characters), hashed to 2^20 buckets;
presence counts, not frequency. The score is the logistic of bias + term weights + pairwise interactions, which the inner
products of the terms' rank-4 factors give, so a pair of terms can weigh more than both alone. No term is chosen or dropped
beforehand: every bucket that the sample holds has a weight and factors, and learns both at once.

The model is fitted with numpy on at most SAMPLE_ROWS labelled rows of together at most SAMPLE_TERMS terms (documented bounds, taken in the
order of a hash of their ids; the rest of the work covers all rows). Null and empty texts have no terms and get the bias's score.
Without any labelled row of either class, the score is the share of toxic rows there are, or 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _labels, _words
from ._shared import cut, discard

SAMPLE_ROWS = 20_000
SAMPLE_TERMS = 1 << 23
BUCKETS = 20
RANK = 4


def terms(texts: list[bytes]) -> list[np.ndarray]:
    """The hashed distinct terms of each text."""
    return [np.unique((h >> np.uint64(64 - BUCKETS)).astype(np.int32)) for h in _words.hashes([t.lower() for t in texts], _words.MARKS)]


class FactorizationMachine:
    """Logistic factorization machine over sets of features."""

    def __init__(self, table: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.table, self.bias, self.weights, self.factors = table, bias, weights, factors

    @classmethod
    def of(cls, chosen: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray) -> FactorizationMachine:
        """The machine whose features are the buckets ``chosen``, in order."""
        table = np.full(1 << BUCKETS, -1, np.int32)
        table[chosen] = np.arange(len(chosen))
        return cls(table, bias, weights, factors)

    def __reduce__(self):  # without the table, which the buckets give again
        return FactorizationMachine.of, (np.flatnonzero(self.table >= 0).astype(np.int32), self.bias, self.weights, self.factors)

    def raw(self, row: np.ndarray, feature: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic, and the factor sums, of ``n`` rows given as (row, feature) pairs."""
        held = self.factors[feature]
        sums = np.stack([np.bincount(row, held[:, f], n) for f in range(held.shape[1])], 1)
        squares = np.bincount(row, (held**2).sum(1), n)
        return self.bias + np.bincount(row, self.weights[feature], n) + 0.5 * ((sums**2).sum(1) - squares), sums

    def rate(self, texts: list[bytes]) -> np.ndarray:
        found = terms(texts)
        row = np.repeat(np.arange(len(found)), [len(t) for t in found])
        feature = self.table[np.concatenate(found)] if found else np.empty(0, np.int32)
        known = feature >= 0
        return logistic(self.raw(row[known], feature[known], len(found))[0])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(found: list[np.ndarray], y: np.ndarray, epochs: int = 8, rate: float = 0.3, sparse: float = 3.0, pairs: float = 0.1, agree: float = 3.0, drop: float = 0.5, seed: int = 7) -> FactorizationMachine:
    """Steps over shuffled batches of rows, over all buckets that the rows hold; each step sees a random half of a text's terms.

    Weights follow the regularized leader (per-coordinate steps; a weight leaves 0 only when its gradients add up to more than ``sparse``, so
    that thousands of idle terms stay silent). Factors start small and leave their start where their gradients agree: when the sum is over
    ``agree`` times the root of the sum of squares.
    """
    random = np.random.default_rng(seed)
    table = np.full(1 << BUCKETS, -1, np.int32)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return FactorizationMachine(table, 30.0 if share == 1 else -30.0, np.zeros(1), np.zeros((1, RANK)))
    term = np.concatenate(found)
    chosen = np.unique(term)
    table[chosen] = np.arange(len(chosen))
    feature = table[term]
    at = np.concatenate([[0], np.cumsum([len(t) for t in found])])
    p = max(1, len(chosen))
    m = FactorizationMachine(table, float(np.log(share / (1 - share))), np.zeros(p), random.normal(0, 0.01, (p, RANK)))
    z, seen = np.zeros(p), np.zeros(p)
    first, zv, moved = m.factors.copy(), np.zeros((p, RANK)), np.zeros((p, RANK))
    size = max(1, min(64, len(y) // 64))
    for _ in range(epochs):
        order = random.permutation(len(y))
        for low in range(0, len(order), size):
            rows = order[low : low + size]
            sizes = at[rows + 1] - at[rows]
            local = np.repeat(np.arange(len(rows)), sizes)
            flat = np.repeat(at[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            held = random.random(len(flat)) >= drop
            local, flat = local[held], flat[held]
            f, place = np.unique(feature[flat], return_inverse=True)
            if not len(f):
                continue
            raw, sums = m.raw(local, feature[flat], len(rows))
            err = logistic(raw) - y[rows]
            m.bias -= 0.1 * rate * float(err.mean())
            err = err[local]
            g = np.bincount(place, err, len(f))
            more = seen[f] + g * g
            z[f] += g - (np.sqrt(more) - np.sqrt(seen[f])) / rate * m.weights[f]
            seen[f] = more
            m.weights[f] = -np.sign(z[f]) * np.maximum(np.abs(z[f]) - sparse, 0) / ((1 + np.sqrt(more)) / rate)
            own = m.factors[f]
            gv = np.stack([np.bincount(place, err * (sums[local, k] - own[place, k]), len(f)) for k in range(RANK)], 1)
            zv[f] += gv
            moved[f] += gv**2
            root = np.sqrt(moved[f])
            m.factors[f] = first[f] - pairs * np.sign(zv[f]) * np.maximum(np.abs(zv[f]) - agree * root, 0) / (0.1 + root)
    return m


def train(docs: DataFrame, labels: DataFrame, learn: Column, most: int = SAMPLE_ROWS) -> FactorizationMachine:
    """Fit on the labels (doc_id, toxic) that ``learn`` allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _labels.slices(batch.column("text")):
                found = terms(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], batch.column("y")[part], pa.array([len(t) for t in found], pa.int64()), pa.array([t.tobytes() for t in found], pa.binary())], names=["doc_id", "y", "n", "terms"])

    rows = cut(_labels.sample(docs, labels, "toxic", learn, most).mapInArrow(run, "doc_id long, y int, n long, terms binary").withColumn("at", F.xxhash64("doc_id")), "toxicity-sample")
    last, total = None, 0
    for at, n in sorted(rows.select("at", "n").collect()):  # most rows at most
        if total + n > SAMPLE_TERMS and last is not None:
            break
        last, total = at, total + n
    if last is None:
        return fit([], np.zeros(0))
    # one task of an executor fits the bounded sample; the driver gets the model alone
    model = rows.where(F.col("at") <= F.lit(last)).select("doc_id", "y", "terms").coalesce(1).mapInArrow(_fit, "bias double, chosen binary, weights binary, factors binary").first()
    discard(rows)
    return FactorizationMachine.of(np.frombuffer(bytes(model["chosen"]), np.int32), model["bias"], np.frombuffer(bytes(model["weights"]), np.float32), np.frombuffer(bytes(model["factors"]), np.float32).reshape(-1, RANK))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    taken = sorted((i, y, t) for b in batches for i, y, t in zip(b.column("doc_id").to_pylist(), b.column("y").to_pylist(), b.column("terms").to_pylist(), strict=True))
    m = fit([np.frombuffer(t, np.int32) for *_, t in taken], np.array([y for _, y, _ in taken], float))
    parts = [np.flatnonzero(m.table >= 0).astype(np.int32), m.weights.astype(np.float32), m.factors.astype(np.float32)]
    yield pa.RecordBatch.from_arrays([pa.array([m.bias], pa.float64()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["bias", "chosen", "weights", "factors"])


def scored(docs: DataFrame, model: FactorizationMachine, keep: dict[str, Column]) -> DataFrame:
    return _labels.score(docs, keep, model.rate).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
