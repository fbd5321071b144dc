"""N-gram Jaccard join with token-combination prefixes.

Two texts link when the Jaccard similarity of their sets of k-word shingles reaches ``percent`` / 100 (over 50, as the sizes of linked
sets then differ by less than a factor of two). The join is exact:

1. One pass over the texts digests each text's shingle set (equal sets form a class, which costs one representative from then on) and
   reports an extended prefix: sets that link share at least l tokens of prefixes that are l - 1 longer than those which must share one.
   Reports meet by token; a class with too few tokens that others report too can't link, and is done.
2. The classes left, mostly copies, report all their tokens. One with too few shared tokens for a link is done as well. What is left is
   counted truly: a token that over OFTEN reports hold is *frequent*, any other *rare*, at every size of the input.
3. A prefix in the order rare before frequent, frequent ones by rising count, is extended until its *coverage* reaches
   n - ceil(t * n) + 1: a rare token covers 1, and the frequent tokens of a hash group cover all but one of them. Rare tokens are indexed
   singly, frequent ones as pairs within their group: two linked sets then share a single token or a pair (else they would share too few
   prefix tokens).
4. Rounds of leaders: in each index entry whose members lie in different components, every member outside the largest component is
   paired with a member of it, another one each round; pairs that sizes or parities (hashed bits, two or more a token) prove apart are
   dropped, the rest verified from their texts, and links contract components. A group of thousands of near copies costs a pair a member
   and round, and few rounds.
5. Entries that stay open go as pairs if they are small. In larger ones, members outside the largest component meet all others: in one unit, or,
   beyond its bound of rows or tokens, in several, to which the outsiders are copied (or, where they are many themselves, in pairs of blocks). Parities
   prove most apart; what is left is verified by matrix products of the texts' sets, of which only links that join components come out. So
   every link that could join two components is tested.

Rows with a null or wordless text have an empty set, and no links. Rows with a null id have no links either, and no component.
Repeated ids keep all their rows; sets, not ids, are what links. Ids are whole numbers; a text that is none raises. A long text's set is
held whole by the task that reads it; units are bounded by tokens, not by rows alone. Classes are named by two 64-bit digests, and
by numbers of their own once few are left.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words
from ._components import components
from ._shared import cut, discard, small_batches, whole_ids

#: A parity has a power of two of bits: so many a token at least, and so many at least.
TOKEN_BITS, LEAST_BITS = 2, 512
_LINK = "a long, b long"
_UNIT = "sig long, i long, j long, id long, c long"
#: Tokens of sets that a task keeps to use again.
_CACHE = 1 << 21
#: Reports go out in runs of at most so many tokens, and classes.
RUN_TOKENS, RUN_CLASSES = 1 << 19, 1 << 15
#: Bytes of input behind a block of reports, and the powers of two that the number of blocks stays between.
BLOCK_BYTES, BLOCK_BITS = 8 << 20, (6, 20)
#: A token that more classes report is frequent. Frequent tokens are known by TABLE_BITS of their hash: 16 MB at any input.
OFTEN = 32
TABLE_BITS = 24
#: Rounds of leaders at most; they end when one leaves over three quarters of the members outside their entries' largest components.
ROUNDS = 3
#: Entries of up to so many members are compared as pairs, larger ones as pairs of blocks of about so many members, or tokens.
PAIR_ROWS = 8
BLOCK_ROWS, BLOCK_TOKENS = 1024, 1 << 20
#: Bits for each wanted id in a filter over ids, and at most in all (a fuller filter only lets more texts through to the join).
ID_BITS, MOST_BITS = 8, 1 << 28


def _sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    return (_words.shingles(h, k) for h in _words.hashes([(t or "").encode().lower() for t in texts]))


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
    return int(d[0]), int(d[1])


def _parity(s: np.ndarray) -> bytes:
    """Bit i: whether an odd number of the set's tokens hash to i. Two sets differ by at least as many tokens as these bits do."""
    bits = max(LEAST_BITS, 1 << (TOKEN_BITS * len(s) - 1).bit_length())
    at = (_words.mix(s) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool)).tobytes()


def _folded(words: np.ndarray) -> np.ndarray:
    """Parities of half the bits: those of the hashes modulo half the size."""
    half = words.shape[1] // 2
    return words[:, :half] ^ words[:, half:]


def _rows_of(parities: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parities), np.uint64).reshape(len(parities), -1)


def _bytes_of(column: pa.Array, most: int = 1 << 19) -> Iterator[slice]:
    """Slices of a batch with few bytes each."""
    at = size = 0
    for i, n in enumerate(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)):
        if size and size + n > most:
            yield slice(at, i)
            at, size = i, 0
        size += int(n)
    if len(column):
        yield slice(at, len(column))


def _needed(n: int, percent: int) -> int:
    """The coverage that a set of ``n`` needs."""
    return n - -(-percent * n // 100) + 1


def _band(n: int) -> int:
    return n.bit_length()


def signatures(s: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The index entries of a set ``s``; ``rank`` is 0 for rare tokens and the count of frequent ones."""
    n = len(s)
    if percent * (n + 1) > 100 * n:  # even a set with just one token more would be too far off, and so would any other that differs
        return s[:0]
    need = _needed(n, percent)
    rare = s[rank == 0]
    if len(rare) >= need:
        return rare[:need]  # s is sorted, and rare tokens go by their hash
    often = s[rank > 0]
    often = often[np.lexsort((often, rank[rank > 0]))]
    out = [rare]
    for band in range(_band(-(-percent * n // 100)), _band(n) + 1):
        groups = max(1, (1 << band) // 32)
        group = (often % np.uint64(groups)).astype(np.int64)
        first = np.zeros(len(often), bool)
        first[np.unique(group, return_index=True)[1]] = True
        covered = len(rare) + np.cumsum(~first)
        end = int(np.searchsorted(covered, need)) + 1
        taken, of = often[:end], group[:end]
        order = np.lexsort((taken, of))
        taken, of = taken[order], of[order]
        for d in range(1, len(taken)):
            same = of[d:] == of[:-d]
            if not same.any():
                break
            out.append(_words.mix(_words.mix(taken[:-d][same]) + taken[d:][same] * np.uint64(3) + np.uint64(band)))
    return np.unique(np.concatenate(out))


def _prefix(n: int, percent: int) -> int:
    """How many tokens a set of ``n`` reports, so that it shares ``_shared_least`` with any that it links to."""
    need = _needed(n, percent)
    return min(n, need - 1 + _extension(need))


def _extension(need: int) -> int:
    return (3 * need + 3) // 4


def _shared_least(n: int, percent: int) -> int:
    """The reports that a set of ``n`` shares at least with any that it links to, the smallest of which has ceil(t * n) tokens."""
    return _extension(_needed(-(-percent * n // 100), percent))


class _Runs:
    """Reports of a task: rows (run, block, tokens, held, times) of tokens, and rows (run, found) of what the run itself has twice.

    Tokens lie sorted in blocks of their hash, 32 bits and 8 bits apart; ``held`` is the run's number of the class, or MANY if several hold a
    token. A class that comes again in a run has its number already.
    """

    MANY = 0xFFFF
    COLUMNS = [("run", pa.int64()), ("block", pa.int64()), ("tokens", pa.binary()), ("held", pa.binary()), ("times", pa.binary()), ("found", pa.binary())]

    def __init__(self, bits: int):
        from pyspark import TaskContext

        self.bits, self.run = bits, TaskContext.get().partitionId() << 24
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[tuple[int, int], int] = {}
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def full(self) -> bool:
        return self.size >= RUN_TOKENS or len(self.numbers) >= RUN_CLASSES

    def add(self, key: tuple[int, int], tokens: np.ndarray) -> int:
        if key not in self.numbers:
            self.numbers[key] = len(self.numbers)
            self.tokens.append(tokens.copy())  # a view would hold the whole set
            self.size += len(tokens)
        return self.numbers[key]

    def flush(self) -> Iterator[tuple]:
        """The run's rows; the next run is a new one."""
        if self.size:
            holder = np.repeat(np.arange(len(self.tokens)), [len(t) for t in self.tokens])
            v = np.concatenate(self.tokens) & np.uint64((1 << (40 + self.bits)) - 1)
            order = np.argsort(v, kind="stable")
            v, holder = v[order], holder[order]
            first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            times = np.diff(np.r_[first, len(v)])
            twice = np.repeat(times > 1, times)
            if twice.any():
                yield (self.run, None, None, None, None, _pack_counts(holder[twice]))
            held = np.where(times > 1, self.MANY, holder[first]).astype("<u2")
            v, times = v[first], np.minimum(times, 255).astype(np.uint8)
            block = (v >> np.uint64(40)).astype(np.int64)
            edge = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                low = (v[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + ((v[a:b] >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8).tobytes()
                yield (self.run, int(block[a]), low, held[a:b].tobytes(), zlib.compress(times[a:b].tobytes(), 1), None)
        self.run += 1
        self._clear()


def _pack_counts(numbers: np.ndarray) -> bytes:
    """How often each number stands in ``numbers``: numbers, then counts."""
    u, c = np.unique(numbers, return_counts=True)
    return u.astype("<u2").tobytes() + c.astype("<u4").tobytes()


def _batches_of(rows: Iterator[tuple], columns: list[tuple[str, pa.DataType]], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Record batches of about so many bytes of binaries."""
    held, size = [], 0

    def made() -> pa.RecordBatch:
        cols = list(zip(*held, strict=True)) or [()] * len(columns)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, columns, strict=True)], names=[n for n, _ in columns])

    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= most:
            yield made()
            held, size = [], 0
    yield made()


_ROW = [("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("idx", pa.int64())]
_SCAN = "doc_id long, n long, k1 long, k2 long, idx long, run long, block long, tokens binary, held binary, times binary, found binary"


def _scan(k: int, percent: int, bits: int):
    """Of each row its set's size and digest, and its class's number in a run; of each run its reports."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        runs = _Runs(bits)
        for batch in batches:
            for part in _bytes_of(batch.column("text")):
                ids, texts = batch.column("doc_id")[part].to_pylist(), batch.column("text")[part].to_pylist()
                for doc_id, s in zip(ids, _sets(texts, k), strict=True):
                    key = _digest(s)
                    if not len(s) or doc_id is None:
                        yield (doc_id, len(s), *key, None, None, *[None] * 5)
                        continue
                    yield (doc_id, len(s), *key, runs.add(key, s[: _prefix(len(s), percent)]), runs.run, *[None] * 5)
                    if runs.full():
                        for row in runs.flush():
                            yield (*[None] * 5, *row)
        for row in runs.flush():
            yield (*[None] * 5, *row)

    return lambda batches: _batches_of(rows(batches), [*_ROW, *_Runs.COLUMNS])


def _scan_all(k: int, bits: int):
    """As ``_scan`` over classes (id, text), with all their tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        runs = _Runs(bits)
        for batch in batches:
            for part in _bytes_of(batch.column("text")):
                for name, s in zip(batch.column("id")[part].to_pylist(), _sets(batch.column("text")[part].to_pylist(), k), strict=True):
                    yield (name, len(s), 0, 0, runs.add((name, 0), s), runs.run, *[None] * 5)
                    if runs.full():
                        for row in runs.flush():
                            yield (*[None] * 5, *row)
        for row in runs.flush():
            yield (*[None] * 5, *row)

    return lambda batches: _batches_of(rows(batches), [*_ROW, *_Runs.COLUMNS])


def _together(batches: Iterator[pa.RecordBatch], key: str, columns: list[str]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each key, which stand together."""
    now, held = None, []
    for batch in batches:
        for name, *row in zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
            if name != now and held:
                yield now, held
                held = []
            now = name
            held.append(tuple(row))
    if held:
        yield now, held


def _meet(bits: int):
    """Of the reports of each block: per run the numbers of the classes whose tokens other runs report too, and the block's frequent tokens.

    The latter as a table of the block's part of the 2^TABLE_BITS hashes: the bit length of the largest count, 0 without a frequent token.
    """
    width = TABLE_BITS - bits

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for block, parts in _together(batches, "block", ["run", "tokens", "held", "times"]):
            sizes = [len(t) // 5 for _, t, *_ in parts]
            v = np.concatenate([np.frombuffer(t, "<u4", n).astype(np.uint64) | (np.frombuffer(t, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)) for n, (_, t, *_) in zip(sizes, parts, strict=True)])
            held = np.concatenate([np.frombuffer(h, "<u2") for *_, h, _ in parts])
            times = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint8) for *_, x in parts])
            order = np.argsort(v, kind="stable")
            v = v[order]
            first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            runs = np.diff(np.r_[first, len(v)])
            twice = np.zeros(len(v), bool)
            twice[order] = np.repeat(runs > 1, runs)
            twice &= held != _Runs.MANY  # whose holders count such tokens themselves
            for (run, *_), a, n in zip(parts, np.cumsum([0, *sizes]).tolist(), sizes, strict=False):
                if (hit := held[a : a + n][twice[a : a + n]]).size:
                    yield (run, _pack_counts(hit), None, None)
            total = np.add.reduceat(times[order].astype(np.int64), first)
            if (often := total > OFTEN).any():
                table = np.zeros(1 << width, np.uint8)
                np.maximum.at(table, (v[first][often] >> np.uint64(40 - width)).astype(np.int64), np.bitwise_count(_below(total[often])).astype(np.uint8))
                yield (None, None, block, zlib.compress(table.tobytes(), 1))

    return lambda batches: _batches_of(rows(batches), [("run", pa.int64()), ("found", pa.binary()), ("block", pa.int64()), ("often", pa.binary())])


def _below(x: np.ndarray) -> np.ndarray:
    """All bits from the highest one of each down: as many as its bit length."""
    for i in (1, 2, 4, 8, 16, 32):
        x = x | (x >> i)
    return x


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run and class number how many of its tokens others hold too."""

    def rows() -> Iterator[tuple]:
        for run, parts in _together(batches, "run", ["found"]):
            total = np.zeros(_Runs.MANY + 1, np.int64)
            for (packed,) in parts:
                n = len(packed) // 6
                total[np.frombuffer(packed, "<u2", n)] += np.frombuffer(packed, "<u4", n, 2 * n)
            at = np.flatnonzero(total)
            yield from zip([run] * len(at), at.tolist(), total[at].tolist(), strict=True)

    return _batches_of(rows(), [("run", pa.int64()), ("idx", pa.int64()), ("shared", pa.int64())])


def block_bits(docs: DataFrame) -> int:
    """How many bits name a block of reports: more for larger inputs, by the size that the plan states."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    low, high = BLOCK_BITS
    return 10 if size >= 1 << 60 else max(low, min(high, (size // BLOCK_BYTES).bit_length()))


def _shared(scanned: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Of the reports in ``scanned``: (run, idx, shared), and (block, often), written out."""
    reports = scanned.where("block is not null").select("block", "run", "tokens", "held", "times")
    met = cut(reports.repartition("block").sortWithinPartitions("block").mapInArrow(_meet(bits), "run long, found binary, block long, often binary"), "met")
    found = met.where("run is not null").select("run", "found").union(scanned.where("found is not null").select("run", "found"))
    return found.repartition("run").sortWithinPartitions("run").mapInArrow(_sums, "run long, idx long, shared long"), met


def _frequent(met: DataFrame, bits: int) -> np.ndarray:
    """The table of frequent tokens, 2^TABLE_BITS bytes at any input."""
    table = np.zeros((1 << bits, 1 << (TABLE_BITS - bits)), np.uint8)
    for block, packed in met.where("often is not null").select("block", "often").toLocalIterator():
        table[block] = np.frombuffer(zlib.decompress(bytes(packed)), np.uint8)
    return table.reshape(-1)


def _sign(k: int, percent: int, shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        for batch in batches:
            for part in _bytes_of(batch.column("text")):
                sigs, names = [], []
                for name, s in zip(batch.column("id")[part].to_pylist(), _sets(batch.column("text")[part].to_pylist(), k), strict=True):
                    v = s & np.uint64((1 << (40 + bits)) - 1)
                    got = signatures(s, table[(v >> np.uint64(40 + bits - TABLE_BITS)).astype(np.int64)].astype(np.int64), percent)
                    sigs.append(got)
                    names.append(np.full(len(got), name, np.int64))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(names))], names=["sig", "id"])

    return run


class _Sets:
    """The sets of the classes that a task met last, found again from their texts."""

    def __init__(self, k: int):
        self.k, self.kept, self.size = k, {}, 0

    def __call__(self, name: int, text: str) -> np.ndarray:
        if name not in self.kept:
            s = next(_sets([text], self.k))
            while self.kept and self.size + len(s) > _CACHE:
                self.size -= len(self.kept.pop(next(iter(self.kept))))
            self.kept[name] = s
            self.size += len(s)
        return self.kept[name]


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _id_at(ids: pa.Array, bits: int) -> np.ndarray:
    return (_words.mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _id_bits(bits: int):
    """The bytes of the filter in which ids set bits, as rows of 2^12 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _together(batches, "part", ["at"]):
            held = np.zeros(1 << 12, bool)
            held[[at for (at,) in rows]] = True
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(held).tobytes()], pa.binary())], names=["part", "bits"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_id_at(batch.column("rep"), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 12), pa.array(at & 0xFFF)], names=["part", "at"])

    return places, run


def _with_bits(shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        for batch in batches:
            at = _id_at(batch.column("doc_id"), bits)
            yield batch.filter(pa.array((held[at >> 3] >> (7 - (at & 7))) & 1 == 1)).rename_columns(["rep", "text"])

    return run


def _match(k: int):
    """Texts (id, n, k1, k2, text) whose set is that of their class, with the set's parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _bytes_of(batch.column("text")):
                b = batch.slice(part.start, part.stop - part.start)
                sets = list(_sets(b.column("text").to_pylist(), k))
                keys = list(zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), strict=True))
                ok = pa.array([_digest(s) == key for s, key in zip(sets, keys, strict=True)], pa.bool_())  # else another row's text under a repeated id
                out = pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), pa.array([_parity(s) for s in sets], pa.binary()), b.column("text")], names=["id", "n", "p", "text"])
                yield out.filter(ok)

    return run


def _may_link(percent: int):
    """Drop pairs that sizes or parities prove not to be linked; no linked pair is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            keep = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            # a link: (100 + p) * both >= p * (na + nb); they differ by na + nb - 2 * both
            most = (100 - percent) * (na + nb) // (100 + percent)
            pa_, pb = batch.column("pa").to_pylist(), batch.column("pb").to_pylist()
            kinds: dict[tuple[int, int], list[int]] = {}
            for i in np.flatnonzero(keep).tolist():
                kinds.setdefault((len(pa_[i]), len(pb[i])), []).append(i)
            for at in kinds.values():
                x, y = _rows_of([pa_[i] for i in at]), _rows_of([pb[i] for i in at])
                while x.shape[1] > y.shape[1]:
                    x = _folded(x)
                while y.shape[1] > x.shape[1]:
                    y = _folded(y)
                keep[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most[at]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _units(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of each unit, which stand together."""
    now, unit = None, []
    for batch in batches:
        for sig, i, j, *member in zip(*(batch.column(c).to_pylist() for c in ("sig", "i", "j", *columns)), strict=True):
            if (sig, i, j) != now:
                if unit:
                    yield now, unit
                now, unit = (sig, i, j), []
            unit.append(tuple(member))
    if unit:
        yield now, unit


def _outside(components: list[int]) -> np.ndarray:
    """Which members lie outside the unit's largest component: every pair of different components has one."""
    names, at, times = np.unique(components, return_inverse=True, return_counts=True)
    return at != int(times.argmax())


def _doubtful(unit: list[tuple], percent: int) -> np.ndarray:
    """Which members (id, c, n, p) neither sizes nor parities prove apart from all members of other components."""
    c, n = np.array([m[1] for m in unit]), np.array([m[2] for m in unit])
    out, outside = np.zeros(len(unit), bool), _outside(c)
    sizes = np.array([len(m[3]) for m in unit])
    for size in np.unique(sizes):  # of linked sets one is at most twice the other, so their parities are of one size or next ones
        own, wide = np.flatnonzero(sizes == size), np.flatnonzero(sizes == 2 * size)
        both = np.concatenate([own, wide])
        words = _rows_of([unit[i][3] for i in own])
        if len(wide):
            words = np.concatenate([words, _folded(_rows_of([unit[i][3] for i in wide]))])
        for at in np.flatnonzero(outside[both]):
            i = both[at]
            may = (c[both] != c[i]) & (100 * np.minimum(n[both], n[i]) >= percent * np.maximum(n[both], n[i]))
            if (some := np.flatnonzero(may)).size:
                apart = np.bitwise_count(words[some] ^ words[at]).sum(axis=1, dtype=np.int64)
                some = some[apart <= (100 - percent) * (n[both[some]] + n[i]) // (100 + percent)]
                out[both[some]] = True
                out[i] |= some.size > 0
    return out


def _borderline(percent: int):
    """The members of a unit that may still be linked to one of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (sig, i, j), unit in _units(batches, ["id", "c", "n", "p"]):
            left = np.flatnonzero(_doubtful(unit, percent)).tolist()
            cols = [[sig] * len(left), [i] * len(left), [j] * len(left), [unit[x][0] for x in left], [unit[x][1] for x in left]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["sig", "i", "j", "id", "c"])

    return run


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _Sets(k)
        for batch in batches:
            found = []
            for part in _bytes_of(batch.column("ta")):
                cols = [batch.column(c)[part].to_pylist() for c in ("a", "ta", "b", "tb")]
                for a, ta, b, tb in zip(*cols, strict=True):
                    x, y = at(a, ta), at(b, tb)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        found.append((a, b))
            yield _links(found)

    return run


def _overlaps(sets: list[np.ndarray], some: np.ndarray, width: int = 2048) -> np.ndarray:
    """The sizes of the intersections of some sets with all, by products of 0/1 matrices over the tokens that at least two sets hold."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    row, token = row[times[token] > 1], rank[token[times[token] > 1]]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    out = np.zeros((len(some), len(sets)), np.float32)
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, (low, low + width))
        held = np.zeros((len(sets), width), np.float32)
        held[row[a:b], token[a:b] - low] = 1
        out += held[some] @ held.T
    return out


def _join_unit(unit: list[tuple], at: _Sets, percent: int) -> list[tuple[int, int]]:
    """Links between members of different components, as few as join all that the unit's links join."""
    if len({c for _, c, _ in unit}) < 2:
        return []
    members = [(name, c, at(name, text)) for name, c, text in unit]
    some = np.flatnonzero(_outside([c for _, c, _ in members]))
    size = np.array([len(s) for *_, s in members], np.float64)
    both = _overlaps([s for *_, s in members], some)
    near = [(i, j) for x, i in enumerate(some.tolist()) for j in np.flatnonzero(100 * both[x] >= percent * (size[i] + size - both[x])).tolist() if i != j]
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    found = []
    for i, j in near:
        a, b = top(members[i][1]), top(members[j][1])
        if a != b:
            root[a] = b
            found.append((members[i][0], members[j][0]))
    return found


def _verify_blocks(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _Sets(k)
        for _, unit in _units(batches, ["id", "c", "text"]):
            yield _links(_join_unit(unit, at, percent))

    return run


class JaccardJoin:
    """The join over ``docs`` (doc_id, text; other columns are not read).

    ``rows``: doc_id, n, k1, k2 per input row, where (k1, k2) names its set. ``classes``: id, k1, k2, rep, n of the sets that may link.
    ``links``: pairs of such classes (a, b as id) that are linked, enough of them to join what links join. ``result()``: doc_id, n_shingles,
    component_id per input row, from files that stay until the folder is cleaned; all others are deleted once read.
    """

    def __init__(self, docs: DataFrame, k: int = 5, percent: int = 80):
        if not 50 < percent <= 100:
            raise ValueError("percent must be over 50")
        self.docs, self.k, self.percent = docs.select(whole_ids(docs, "doc_id"), F.col("text").cast("string").alias("text")), k, percent
        self.spark = docs.sparkSession
        with small_batches(self.spark):
            scanned, self.rows = self._scanned()
            self.texts = self._left(scanned)
            discard(scanned)
            self.index = self._indexed()
            self._solve()
        self.table.destroy()
        discard(self.texts, self.index, self.parity)

    def _least(self, n: str) -> str:
        """ceil(t * n) in SQL."""
        return f"(({self.percent} * {n} + 99) div 100)"

    def _scanned(self) -> tuple[DataFrame, DataFrame]:
        self.bits = block_bits(self.docs)
        scanned = cut(self.docs.mapInArrow(_scan(self.k, self.percent, self.bits), _SCAN), "scan")
        rows = scanned.where("k1 is not null").select("doc_id", "n", "k1", "k2", "idx", "run")
        return scanned, cut(rows, "rows")

    def _left(self, scanned: DataFrame) -> DataFrame:
        """(id, n, p, text) of the classes that share enough of their reports with others to be linked to one."""
        percent = self.percent
        counts, met = _shared(scanned, self.bits)
        small = self._least("n")
        need = f"({small} - (({percent} * {small} + 99) div 100) + 1)"
        kept = self.rows.join(counts, ["run", "idx"]).where(f"shared >= (3 * {need} + 3) div 4").select("k1", "k2").distinct()
        reps = self.rows.where("idx is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
        self.classes = cut(reps.join(kept, ["k1", "k2"]).withColumn("id", F.monotonically_increasing_id()), "classes")
        discard(met)
        near = self._near(self.classes.select("rep"), self.classes.count()).join(self.classes, "rep").select("rep", "id", "n", "k1", "k2", "text").distinct()
        texts = cut(near.mapInArrow(_match(self.k), "id long, n long, p binary, text string"), "texts")
        again = cut(texts.select("id", "text").mapInArrow(_scan_all(self.k, self.bits), _SCAN), "scan-again")
        counts, met = _shared(again, self.bits)
        kept = cut(again.where("k1 is not null").join(counts, ["run", "idx"]).where(f"shared >= {self._least('n')}").select(F.col("doc_id").alias("id")), "left")
        out = cut(texts.join(kept, "id", "left_semi"), "texts-left")
        self.table = self.spark.sparkContext.broadcast(zlib.compress(_frequent(met, self.bits).tobytes(), 1))
        discard(texts, again, met, kept)
        return out

    def _near(self, wanted: DataFrame, n: int) -> DataFrame:
        """(rep, text) of the rows whose id is wanted (rep), and a few more: what a filter of 8 bits an id, 32 MB at most, lets through."""
        bits = max(12, min(MOST_BITS.bit_length() - 1, (ID_BITS * n).bit_length()))
        places, ones = _id_bits(bits)
        parts = wanted.mapInArrow(places, "part long, at long").repartition("part").sortWithinPartitions("part").mapInArrow(ones, "part long, bits binary")
        held = np.zeros((1 << (bits - 12), 1 << 9), np.uint8)
        for part, packed in parts.toLocalIterator():
            held[part] = np.frombuffer(bytes(packed), np.uint8)
        shared = self.spark.sparkContext.broadcast(zlib.compress(held.tobytes(), 1))
        return self.docs.where("doc_id is not null").mapInArrow(_with_bits(shared, bits), "rep long, text string")

    def _indexed(self) -> DataFrame:
        """(sig, id, n): the entries that two classes or more share."""
        signed = cut(self.texts.select("id", "text").mapInArrow(_sign(self.k, self.percent, self.table, self.bits), "sig long, id long"), "signatures")
        entries = signed.groupBy("sig").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low != high").select("sig")
        self.parity = cut(self.texts.select("id", "n", "p"), "parities")
        out = cut(signed.join(entries, "sig").join(self.parity.select("id", "n"), "id").select("sig", "id", "n"), "index")
        discard(signed)
        return out

    def _likely(self, pairs: DataFrame) -> DataFrame:
        """The ``pairs`` (a < b) that sizes and parities leave."""
        for side in ("a", "b"):
            pairs = pairs.join(self.parity.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("p").alias(f"p{side}")), side)
        return pairs.mapInArrow(_may_link(self.percent), _LINK)

    def _test(self, pairs: DataFrame) -> DataFrame:
        """The links among ``pairs`` (a < b), from their texts."""
        near = cut(self._likely(pairs.distinct()), "pairs")
        self.spent.append(near)
        for side in ("a", "b"):
            near = near.join(self.texts.select(F.col("id").alias(side), F.col("text").alias(f"t{side}")), side)
        return near.select("a", "ta", "b", "tb").mapInArrow(_verify(self.k, self.percent), _LINK)

    def _dealt(self, entries: DataFrame) -> DataFrame:
        """Large ``entries`` as bounded units (sig, i, j) of about BLOCK_ROWS or BLOCK_TOKENS, in which each outsider meets every other member.

        Members of the largest component go to one block, outsiders to all of them. Where the outsiders alone exceed the bound, members go to blocks
        of half of it, and two blocks make a unit.
        """
        def blocks(rows: str, tokens: str):
            return F.greatest(F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(tokens) / BLOCK_TOKENS), F.lit(1).cast("long"))

        many = blocks("outside", "tokens_outside") > 1
        dealt = entries.withColumn("blocks", F.when(many, 2 * blocks("m", "tokens")).otherwise(blocks("m", "tokens")))
        dealt = dealt.withColumns({"mine": F.pmod(F.xxhash64("id"), "blocks"), "pairs": many, "out": F.col("c") != F.col("main")})
        every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        dealt = dealt.withColumn("other", F.explode(F.when(F.col("pairs") | F.col("out"), every).otherwise(F.array("mine"))))
        i = F.when(F.col("pairs"), F.least("mine", "other")).otherwise(F.col("other"))
        return dealt.select("sig", i.alias("i"), F.when(F.col("pairs"), F.greatest("mine", "other")).otherwise(F.col("other")).alias("j"), "id", "c")

    def _open(self, entries: DataFrame, links: DataFrame | None, name: str) -> DataFrame:
        """The ``entries`` (sig, id, n) whose members lie in different components of ``links``: sig, id, n, c, main (the largest component), m members, tokens, and the same of those outside."""
        labelled = entries.select("sig", "id", "n", F.col("id").alias("c"))
        if links is not None:
            found = components(links, "a", "b")
            self.spent.append(found)
            labelled = entries.select("sig", "id", "n").join(found.withColumnRenamed("node", "id"), "id", "left").select("sig", "id", "n", F.coalesce("component", "id").alias("c"))
        seal = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
        parts = labelled.groupBy("sig", "c").agg(F.count("*").alias("m"), F.sum("n").alias("tokens"), *seal)
        ends = parts.groupBy("sig").agg(F.sum("m").alias("m"), F.sum("tokens").alias("tokens"), F.max(F.struct("m", "tokens", "c")).alias("main"), *(F.bit_xor(f"x{i}").alias(f"x{i}") for i in (1, 2)))
        ends = ends.where("main.m < m").groupBy("m", "tokens", "main", "x1", "x2").agg(F.min("sig").alias("sig"))  # of entries with the same members one is enough
        ends = ends.select("sig", "m", "tokens", F.col("main.c").alias("main"), (F.col("m") - F.col("main.m")).alias("outside"), (F.col("tokens") - F.col("main.tokens")).alias("tokens_outside"))
        out = cut(labelled.join(ends, "sig"), name)
        self.spent.append(out)
        return out

    def _solve(self) -> None:
        def pair(x: str, y: str) -> list:
            return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

        self.spent: list[DataFrame] = []
        links = None

        def add(found: DataFrame) -> DataFrame:
            out = cut(found if links is None else links.union(found), "links")
            self.spent.append(out)
            return out

        still = self._open(self.index, None, "open")
        left = still.where("c != main").count()
        for turn in range(ROUNDS):
            if not left:
                break
            leader = still.where("c = main").groupBy("sig").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id").alias("id"))).alias("l"))
            outside = still.where("c != main").join(leader.select("sig", F.col("l.id").alias("lead")), "sig")
            links = add(self._test(outside.select(*pair("id", "lead"))))
            still = self._open(still, links, "open")
            left, before = still.where("c != main").count(), left
            if 4 * left > 3 * before:
                break
        if left:
            few, many = still.where(F.col("m") <= PAIR_ROWS), still.where(F.col("m") > PAIR_ROWS)
            other = few.select("sig", F.col("id").alias("other"), F.col("c").alias("oc"))
            links = add(self._test(few.join(other, "sig").where("c < oc").select(*pair("id", "other"))))
            many = self._open(many, links, "open")
            held = self._dealt(many).join(self.parity, "id").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
            units = cut(held.mapInArrow(_borderline(self.percent), _UNIT), "units")
            self.spent.append(units)
            texts = units.join(self.texts.select("id", "text"), "id").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
            links = add(texts.mapInArrow(_verify_blocks(self.k, self.percent), _LINK))
        self.links = cut(links if links is not None else self.index.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0), "links")
        self.found = cut(components(self.links, "a", "b"), "components")
        discard(*self.spent)

    def result(self) -> DataFrame:
        named = self.classes.join(self.found.withColumnRenamed("node", "id"), "id")
        least = named.groupBy("component").agg(F.min("rep").alias("least"))
        linked = named.join(least, "component").select("k1", "k2", "least")
        ok = F.col("idx").isNotNull()
        copies = self.rows.where(ok).groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("times")).where("times > 1").select("k1", "k2", "rep")
        of = copies.join(linked, ["k1", "k2"], "full").select("k1", "k2", F.coalesce("least", "rep").alias("component_id"))
        some = self.rows.where(ok).join(of, ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        none = self.rows.where(~ok).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return some.union(none)


def ngram_jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id that links reach; null for a null id)."""
    return JaccardJoin(docs, k, percent).result()


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS sh FROM d),
c AS (SELECT *, md5(array_to_string(sh, chr(10))) AS k, len(sh)::BIGINT AS n FROM s),
r AS (SELECT k, min(doc_id) AS rep, min(n) AS n, any_value(sh) AS sh FROM c WHERE n > 0 GROUP BY k),
u AS (SELECT rep, n, unnest(sh) AS g FROM r),
l AS (SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 90 * (min(a.n) + min(b.n) - count(*))),
e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
t(x, y) AS (SELECT rep, rep FROM r UNION SELECT t.x, e.y FROM t JOIN e ON e.x = t.y),
m AS (SELECT x, min(y) AS least FROM t GROUP BY x)
SELECT doc_id, c.n AS n_shingles, coalesce(least, doc_id) AS component_id FROM c LEFT JOIN r USING (k) LEFT JOIN m ON m.x = r.rep
"""
