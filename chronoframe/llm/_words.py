"""Vectorised word splitting and 64-bit word hashes over UTF-8 bytes.

Words are maximal runs of bytes outside a set of separators, by default 0x20 and 0x09-0x0D. A word's hash is a polynomial over a table of random
64-bit values, found for all words of a segment at once from one wrapping cumulative sum:
``(S[end] - S[start]) * B ** -start`` with odd ``B``. Segments are cut at separators, so memory follows the segment
(or the longest word), not the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SEGMENT = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Which bytes separate words: white space; everything but digits, letters and non-ASCII bytes; line feeds.
SPACE, MARKS, LINES = np.zeros(256, bool), np.ones(256, bool), np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LINES[0x0A] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(SEGMENT, n) + 1
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _powers.append(np.cumprod(t, dtype=np.uint64))
    return _powers[0], _powers[1]


def spans(buf: bytes, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, and the start and end of each word."""
    a = np.frombuffer(buf, np.uint8)
    inside = np.empty(len(a) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~gap[a]
    edge = np.flatnonzero(np.diff(inside))
    return a, edge[::2], edge[1::2]


def _hash_segment(buf: bytes, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, start, end = spans(buf, gap)
    power, inverse = _power_tables(len(a))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_TABLE[a] * power[: len(a)], out=total[1:])
    return start, mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def _segments(buf: bytes, gap: np.ndarray) -> Iterator[bytes]:
    at = 0
    while len(buf) - at > SEGMENT:
        window = np.frombuffer(buf, np.uint8, SEGMENT, at)
        gaps = np.flatnonzero(gap[window])
        if len(gaps):
            stop = at + int(gaps[-1]) + 1
        else:  # one word fills the segment: go on to its end
            rest = np.flatnonzero(gap[np.frombuffer(buf, np.uint8, -1, at)])
            stop = at + int(rest[0]) + 1 if len(rest) else len(buf)
        yield buf[at:stop]
        at = stop
    yield buf[at:]


def hashes(texts: Iterable[bytes], gap: np.ndarray = SPACE) -> Iterator[np.ndarray]:
    """For each text the uint64 hashes of its words, in order; short texts are hashed together."""
    group: list[bytes] = []
    size = 0
    for t in texts:
        if len(t) > SEGMENT // 2:
            yield from _flush(group, gap)
            group, size = [], 0
            yield np.concatenate([_hash_segment(s, gap)[1] for s in _segments(t, gap)])
            continue
        if size + len(t) + 1 > SEGMENT:
            yield from _flush(group, gap)
            group, size = [], 0
        group.append(t)
        size += len(t) + 1
    yield from _flush(group, gap)


def _flush(group: list[bytes], gap: np.ndarray) -> Iterator[np.ndarray]:
    if not group:
        return
    start, h = _hash_segment(bytes([int(np.argmax(gap))]).join(group), gap)
    ends = np.cumsum([len(t) + 1 for t in group])
    yield from np.split(h, np.searchsorted(start, ends[:-1]))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's ``k``-word shingles; a shorter text is one shingle, an empty one none."""
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    s = np.full(n, k, np.uint64)
    for i in range(k):
        s = mix(s * np.uint64(_BASE) + h[i : i + n])
    return np.unique(s)
