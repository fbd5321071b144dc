"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are found with numpy for many texts at once. Trees are grown level by level from histograms of 64 quantile bins,
and stored as complete trees in flat arrays (feature, bin, leaf value), which a batch of rows walks together, one gather per
level. The model is fitted on at most SAMPLE_ROWS labelled rows (a documented bound); all rows are scored.

Null and empty texts have all statistics 0 and get the score that the trees give these. Without labelled rows of both classes
the score is the share of good rows there are, or 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _labels, _words
from .toxicity import logistic

SAMPLE_ROWS = 20_000
BINS, DEPTH, TREES, RATE = 64, 4, 80, 0.15
STATISTICS = [
    "words", "word_length", "distinct_words", "repeated_windows", "lines", "line_words", "repeated_lines",
    "upper", "lower", "digits", "points", "symbols", "exclaims", "pipes", "other_marks", "non_ascii", "spaces",
]
_KIND = np.full(256, 7, np.uint8)  # bytes by kind: upper, lower, digits, . , ; : ?, symbols, !, |, other marks, non-ASCII, spaces
for _k, _chars in enumerate([range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), b".,;:?", b"#*$%&<>", b"!", b"|"]):
    _KIND[[*_chars]] = _k
_KIND[0x80:] = 8
_KIND[[0x20, *range(9, 14)]] = 9


def _repeats(h: np.ndarray) -> float:
    return 1 - len(np.unique(h)) / len(h) if len(h) else 0.0


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    out = np.zeros((len(texts), len(STATISTICS)))
    sizes = np.array([len(t) for t in texts], np.int64)
    kinds = np.zeros((len(texts), 10))
    buf = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)
    for i, (end, n) in enumerate(zip(ends, sizes, strict=True)):
        kinds[i] = np.bincount(_KIND[buf[end - n : end]], minlength=10)[:10]
    for i, (words, lines) in enumerate(zip(_words.hashes(texts), _words.hashes(texts, _words.LINES), strict=True)):
        n = len(words)
        if n:
            inked = kinds[i, :9].sum()
            windows = _words.mix(words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(5) + words[2:] * np.uint64(7))
            out[i, :7] = n, inked / n, len(np.unique(words)) / n, _repeats(windows), len(lines), n / max(1, len(lines)), _repeats(lines)
    out[:, 7:] = kinds / np.maximum(1, sizes)[:, None]
    return out


class BoostedTrees:
    """Complete trees in flat arrays: node k of a tree has the children 2k + 1 and 2k + 2."""

    def __init__(self, edges: list[np.ndarray], base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.edges, self.base, self.feature, self.cut, self.leaf = edges, base, feature, cut, leaf

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        total, rows, depth = np.full(len(bins), self.base), np.arange(len(bins)), DEPTH
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(bins), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            total += leaf[node - (2**depth - 1)]
        return total

    def rate(self, texts: list[bytes]) -> np.ndarray:
        return logistic(self.raw(self.binned(statistics(texts))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE, ridge: float = 1.0, least: int = 10) -> BoostedTrees:
    """Newton boosting of the logistic loss."""
    share = float(y.mean()) if len(y) else 0.0
    inner = 2**DEPTH - 1
    if not 0 < share < 1:
        return BoostedTrees([np.zeros(0)] * x.shape[1], 30.0 if share == 1 else -30.0, *(np.zeros((0, n)) for n in (inner, inner, inner + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    m = BoostedTrees(edges, float(np.log(share / (1 - share))), *(np.zeros((trees, n), t) for n, t in ((inner, np.int64), (inner, np.int64), (inner + 1, float))))
    bins, rows, wide = m.binned(x), np.arange(len(y)), x.shape[1] * BINS
    slot = bins + BINS * np.arange(x.shape[1])
    now = np.full(len(y), m.base)
    for t in range(trees):
        p = logistic(now)
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * wide + slot).ravel()
            hist = [np.bincount(at, np.repeat(v, x.shape[1]), count * wide).reshape(count, x.shape[1], BINS).cumsum(2) for v in (g, h, np.ones(len(y)))]
            gl, hl, nl = (v[:, :, :-1] for v in hist)
            gt, ht, nt = (v[:, :, -1:] for v in hist)
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain = np.where((nl >= least) & (nt - nl >= least), gain, 0).reshape(count, -1)
            best = gain.argmax(1)
            worth = gain[np.arange(count), best] > 1e-6
            m.feature[t, first : first + count] = np.where(worth, best // (BINS - 1), 0)
            m.cut[t, first : first + count] = np.where(worth, best % (BINS - 1), BINS)  # all rows go left
            node = 2 * node + 1 + (bins[rows, m.feature[t][node]] > m.cut[t][node])
        at = node - inner
        m.leaf[t] = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        now += m.leaf[t][at]
    return m


def train(docs: DataFrame, labels: DataFrame, learn: Column, most: int = SAMPLE_ROWS) -> BoostedTrees:
    """Fit on the labels (doc_id, quality) that ``learn`` allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _labels.slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], batch.column("y")[part], pa.array([r.tobytes() for r in statistics(texts)], pa.binary())], names=["doc_id", "y", "x"])

    rows = _labels.sample(docs, labels, "quality", learn, most).mapInArrow(run, "doc_id long, y int, x binary").collect()
    rows.sort(key=lambda r: (r[0], r[1], bytes(r[2])))
    x = np.array([np.frombuffer(bytes(r[2])) for r in rows]).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([r[1] for r in rows], float))


def scored(docs: DataFrame, model: BoostedTrees, keep: dict[str, Column]) -> DataFrame:
    return _labels.score(docs, keep, model.rate).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
