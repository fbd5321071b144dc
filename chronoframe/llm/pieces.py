"""SentencePiece encoding and decoding by batched searches in numpy.

A text's spaces become U+2581, one more stands before it, and it falls apart where no piece can reach across: before runs of
U+2581 and around line feeds. These parts (words) are looked up in a bounded cache; the missing ones of a batch advance
together, equal lengths at once, and hashes of substrings probe the sorted hashes of the pieces.

* Unigram models: a Viterbi search, position by position. Of all pieces that end there the best total score stays (of equal
  ones that with the longest last piece), and the length of its last piece is the way back.
* BPE models (the public file is one): a best total of merge ranks is not what such a model means, and its ids would not be the
  library's. Each round merges in every word the neighbours whose piece has the best score, leftmost first, until none fit.
  Words of over LONG characters are merged one by one with a heap.

Characters in no piece become their UTF-8 bytes' pieces.

``decode`` is exact: a U+2581 in a text is spelt in byte pieces, so it comes back as itself. Null and empty texts have
no pieces and decode to the empty text. Memory holds one batch, the cache, and a matrix of the longest words.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import slices
from ._words import mix

MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
CACHE_WORDS = 400_000
CELLS = 1 << 18
LONG = 2048
_WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Hashes of each row's prefixes: (rows, length + 1)."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _BASE + codes[:, j] + np.uint64(1)
    return out


class Pieces:
    """The pieces and scores of a model file, and encoding with them."""

    def __init__(self, name: str = "piece_bpe_32k", merges: bool | None = None):
        """``merges``: whether it is a BPE model; by default whether all its scores are whole numbers (merge ranks)."""
        import public_tokenizers as public
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=str(public.path(f"{name}.model")))
        n = m.get_piece_size()
        self.bytes_of = [b""] * n
        self.byte_id = {}
        plain = []
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_id[int(piece[3:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:-1], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
                plain.append((piece, i, m.get_score(i)))
        self.merges = all(float(s).is_integer() for *_, s in plain) if merges is None else merges
        self._set(plain)

    def _set(self, plain: list[tuple[str, int, float]]) -> None:
        if any("\n" in p or MARK in p.lstrip(MARK) for p, *_ in plain):
            raise ValueError("a piece reaches across words")
        self.longest = max(len(p) for p, *_ in plain)
        self.unknown = min(s for *_, s in plain) - 10
        keys = np.array([mix(_prefixes(_codes([p]))[:, -1])[0] for p, *_ in plain], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ids = np.array([i for _, i, _ in plain])[order]
        self.scores = np.array([s for *_, s in plain])[order]
        self.lengths = sorted({len(p) for p, *_ in plain}, reverse=True)
        self.by_piece = {p: (s, i) for p, i, s in plain}
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(LONG, self.longest), _BASE)]).astype(np.uint64))
        # the slots of the sorted keys by their first bits, so that a probe looks at few of them
        self.slot = np.searchsorted(self.keys, np.arange((1 << 16) + 1, dtype=np.uint64) << np.uint64(48))
        self.slot[-1] = len(self.keys)
        self.deep = int(np.diff(self.slot).max())
        self.cache: dict[str, bytes] = {}

    def _probe(self, h: np.ndarray) -> np.ndarray:
        """Where each hash stands among the keys; -1 where it does not."""
        lead = (h >> np.uint64(48)).astype(np.int64)
        at, end = self.slot[lead], self.slot[lead + 1]
        out = np.full(len(h), -1)
        for _ in range(self.deep):
            inside = np.flatnonzero(at < end)
            if not len(inside):
                break
            hit = self.keys[at[inside]] == h[inside]
            out[inside[hit]] = at[inside[hit]]
            at[inside] += 1
        return out

    def _spell(self, part: str) -> list[int]:
        """The id of a piece, or the ids of a character's bytes."""
        found = self.by_piece.get(part)
        return [found[1]] if found else [self.byte_id[b] for b in part.encode()]

    def _merge(self, words: list[str]) -> Iterator[bytes]:
        """The ids of words of one length, by merges."""
        codes = _codes(words)
        rows, size = codes.shape
        prefix = _prefixes(codes)
        after = np.tile(np.arange(1, size + 2), (rows, 1))  # where the part that starts here ends
        before = np.tile(np.arange(-1, size), (rows, 1))  # where the part before it starts
        worth = np.full((rows, size), -np.inf)  # the score of the part's merge with the next one

        def score(r: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = np.full(len(r), -np.inf)
            near = np.flatnonzero(b - a <= self.longest)
            r, a, b = r[near], a[near], b[near]
            at = self._probe(mix(prefix[r, b] - prefix[r, a] * self.power[b - a]))
            out[near] = np.where(at >= 0, self.scores[at], -np.inf)
            return out

        r, a = (x.ravel() for x in np.indices((rows, size - 1)))
        worth[r, a] = score(r, a, a + 2)
        live, starts = np.arange(rows), np.ones((rows, size), bool)
        while len(live):
            i = worth[live].argmax(axis=1)
            go = worth[live, i] > -np.inf
            live, i = live[go], i[go]
            j = after[live, i]
            k = after[live, j]
            after[live, i] = k
            starts[live, j] = False
            worth[live, j] = worth[live, i] = -np.inf
            more = np.flatnonzero(k < size)
            before[live[more], k[more]] = i[more]
            worth[live[more], i[more]] = score(live[more], i[more], after[live[more], k[more]])
            less = np.flatnonzero(i > 0)
            p = before[live[less], i[less]]
            worth[live[less], p] = score(live[less], p, k[less])
        r, a = np.nonzero(starts)
        b = after[r, a]
        at = self._probe(mix(prefix[r, b] - prefix[r, a] * self.power[b - a]))
        ids = self.ids[at].astype("<u4").tobytes()
        ends = np.cumsum(4 * np.bincount(r, minlength=rows)).tolist()
        spelt = np.zeros(rows, bool)
        spelt[r[at < 0]] = True
        for i, (word, end) in enumerate(zip(words, ends, strict=True)):
            if spelt[i]:
                mine = np.flatnonzero(starts[i])
                yield _packed([x for y in mine for x in self._spell(word[y : after[i, y]])])
            else:
                yield ids[ends[i - 1] if i else 0 : end]

    def _merge_long(self, word: str) -> bytes:
        """The same for one word, with a heap."""
        size = len(word)
        after, before = list(range(1, size + 2)), list(range(-1, size))
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            c = after[b] if b < size else 0
            if b < size and c - a <= self.longest and (found := self.by_piece.get(word[a:c])):
                heapq.heappush(heap, (-found[0], a, b, c))

        for a in range(size - 1):
            offer(a, a + 1)
        gone = bytearray(size + 1)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if gone[a] or gone[b] or after[a] != b or after[b] != c:
                continue
            after[a], gone[b] = c, 1
            if c < size:
                before[c] = a
            offer(a, c)
            if a:
                offer(before[a], a)
        out, i = [], 0
        while i < size:
            out += self._spell(word[i : after[i]])
            i = after[i]
        return _packed(out)

    def _search(self, words: list[str]) -> Iterator[bytes]:
        """The ids of words of one length."""
        codes = _codes(words)
        rows, size = codes.shape
        prefix = _prefixes(codes)
        best = np.full((rows, size + 1), -np.inf)
        best[:, 0] = 0
        step = np.ones((rows, size + 1), np.int64)
        piece = np.full((rows, size + 1), -1, np.int64)
        for j in range(1, size + 1):
            top = best[:, j - 1] + self.unknown
            for n in self.lengths:
                if n > j:
                    continue
                at = self._probe(mix(prefix[:, j] - prefix[:, j - n] * self.power[n]))
                total = np.where(at >= 0, best[:, j - n] + self.scores[at], -np.inf)
                better = (total > top) | ((total == top) & (piece[:, j] < 0) & (total > -np.inf))
                top = np.where(better, total, top)
                step[better, j] = n
                piece[better, j] = self.ids[at[better]]
            best[:, j] = top
        for word, s, p in zip(words, step.tolist(), piece.tolist(), strict=True):
            out, j = [], len(word)
            while j:
                out.extend([p[j]] if p[j] >= 0 else [self.byte_id[b] for b in reversed(word[j - 1].encode())])
                j -= s[j]
            yield _packed(out[::-1])

    def _learn(self, words: set[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for n, of in by_length.items():
            rows = max(1, CELLS // n)
            for i in range(0, len(of), rows):
                some = of[i : i + rows]
                found = map(self._merge_long, some) if self.merges and n > LONG else (self._merge if self.merges else self._search)(some)
                self.cache.update(zip(some, found, strict=True))

    def encode(self, texts: list[str]) -> list[tuple[int, bytes]]:
        """Of each text the number of its words and its ids as little-endian unsigned 32-bit numbers."""
        parts = []
        for t in texts:
            runs = [_WORD.findall(r.replace(" ", MARK)) for r in (f" {t}" if t else "").split(MARK)]
            parts.append(runs)
        words = {w for runs in parts for r in runs for w in r}
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.cache.clear()
        self._learn(words - self.cache.keys())
        mark = np.array([self.byte_id[b] for b in MARK.encode()], "<u4").tobytes()
        get = self.cache.__getitem__
        return [(sum(map(len, runs)), mark.join(b"".join(map(get, r)) for r in runs)) for runs in parts]

    def decode(self, ids: bytes) -> str:
        joined = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return joined.decode("utf-8", "replace").removeprefix(" ")


_COLUMNS = "doc_id long, n_words long, n_pieces long, ids binary"


def _encoded(model: Pieces, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch.column("text")):
            got = model.encode([t.decode() for t in texts])
            counts = [pa.array([n for n, _ in got], pa.int64()), pa.array([len(i) // 4 for _, i in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], *counts, pa.array([i for _, i in got], pa.binary())], names=["doc_id", "n_words", "n_pieces", "ids"])


def _texts(docs: DataFrame) -> DataFrame:
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, name: str = "piece_bpe_32k") -> DataFrame:
    """Per row: doc_id, n_words, n_pieces, ids (little-endian unsigned 32-bit)."""
    return _texts(docs).mapInArrow(lambda batches: _encoded(Pieces(name), batches), _COLUMNS)


def decode(encoded: DataFrame, name: str = "piece_bpe_32k") -> DataFrame:
    """``encoded`` with ``text`` in place of ``ids``; null ids give a null text."""
    out = encoded.drop("ids").withColumn("text", F.lit("")).schema
    names = [c for c in encoded.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(name)
        for batch in batches:
            texts = pa.array([None if i is None else model.decode(i) for i in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), texts], names=[*names, "text"])

    return encoded.mapInArrow(run, out)


def report(docs: DataFrame, name: str = "piece_bpe_32k") -> DataFrame:
    """Per row: doc_id, n_words, n_pieces, ids_crc32, decoded_bytes, decoded_sha256 (of the text that the ids decode to)."""
    kinds = "doc_id long, n_words long, n_pieces long, ids_crc32 long, decoded_bytes long, decoded_sha256 string"
    columns = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(name)
        for batch in _encoded(model, batches):
            ids = batch.column("ids").to_pylist()
            texts = [model.decode(i).encode() for i in ids]
            made = [pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns[:3]), *made], names=columns)

    return _texts(docs).mapInArrow(run, kinds)
