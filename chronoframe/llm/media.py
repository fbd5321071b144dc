"""Media columns: AVI files with motion-JPEG frames, and the shots in them.

``parse_avi`` walks the RIFF chunks and takes the first video stream's frames from the ``idx1`` index (or from ``movi`` and the ``rec `` lists in it
where there is none), and from the ``AVIX`` segments that follow; ``decode_jpeg`` reads baseline JPEG frames, with the standard's code tables where a
frame has none; ``shots`` cuts where the histogram of a frame differs from the one before by
much more than frames lately did; ``clips`` turns a column of AVI files into timed clip rows.

``store`` writes bytes losslessly as such a file: the format's unit is the quantised DCT coefficient. A block of 64 bytes
is a block of 64 coefficients; byte b is the coefficient whose eight magnitude bits are b (b from 128, b - 255 below), so every
coefficient has the same size category and its code one bit, and blocks have a restart marker between them. Any baseline
decoder reads these frames; the one here finds blocks of that layout for many frames at once and falls back to reading
bits one by one for all others.

A null or broken file gives no clips; a null text is stored like an empty one. Frames are independent of each other and
of other files, and pixels come from integer arithmetic, so equal files give equal results in any batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import slices

UNIT = 64
ACROSS, DOWN = 8, 8  # blocks of a frame
FRAME_US = 40_000
LEVELS = 16
WINDOW = 8


def _zigzag() -> np.ndarray:
    """The place in the block of each coefficient in the order of the stream."""
    at = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in at])


ZIGZAG = _zigzag()


def _inverse_dct() -> np.ndarray:
    """Coefficients (row by row) to pixels, as whole 4096ths: products and sums are exact in doubles in any order."""
    k = np.arange(8)
    one = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5)
    return np.rint(np.einsum("ux,vy->uvxy", one, one).reshape(64, 64) * 4096)


_IDCT = _inverse_dct()
_STORED_IDCT = _IDCT[ZIGZAG]


def pixels(coefficients: np.ndarray, matrix: np.ndarray = _IDCT) -> np.ndarray:
    """(blocks, 64) dequantised coefficients to (blocks, 64) samples 0-255."""
    return np.clip(np.floor((coefficients.astype(np.float64) @ matrix + 2048) / 4096) + 128, 0, 255).astype(np.uint8)


# --- AVI ---


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, comment: bytes, frame_us: int = FRAME_US) -> bytes:
    """A RIFF AVI file with one MJPG stream, an index, and a comment."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", frame_us, 0, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, frame_us, 1_000_000, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", comment))
    movi, index, at = [], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    return _chunk(b"RIFF", b"AVI " + head + info + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(tag, start, end) of each chunk; lists go by their kind."""
    while at + 8 <= end:
        tag, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        start, stop = at + 8, min(at + 8 + size, end)
        if tag == b"LIST":
            tag, start = data[start : start + 4], start + 4
        yield tag, start, stop
        at = at + 8 + size + size % 2


def _segments(data: bytes) -> Iterator[dict[bytes, tuple[int, int]]]:
    """The parts (tag -> start, end) of each RIFF segment: the ``AVI `` one, then the ``AVIX`` ones that long files go on with."""
    at = 0
    while data[at : at + 4] == b"RIFF" and data[at + 8 : at + 12] == (b"AVIX" if at else b"AVI "):
        size, parts = struct.unpack_from("<I", data, at + 4)[0], {}
        for tag, start, end in _chunks(data, at + 12, min(at + 8 + size, len(data)) if size else len(data)):
            parts.setdefault(tag, (start, end))
        yield parts
        at += 8 + size + size % 2


def _video_stream(data: bytes, head: tuple[int, int]) -> tuple[bytes, int]:
    """The first video stream's number, as its chunks are named, and its microseconds a frame (0 if unknown)."""
    number = 0
    for tag, start, end in _chunks(data, *head):
        if tag == b"strl":
            for kind, a, b in _chunks(data, start, end):
                if kind == b"strh" and data[a : a + 4] == b"vids":
                    scale, rate = struct.unpack_from("<II", data, a + 20) if b - a >= 28 else (0, 0)
                    return b"%02d" % number, scale * 1_000_000 // rate if rate else 0
            number += 1
    if number:
        raise ValueError("no video stream")
    return b"00", 0


def _walk(data: bytes, start: int, end: int, names: tuple[bytes, ...]) -> Iterator[tuple[int, int]]:
    """Where the chunks of these names lie, those in ``rec `` lists too, in the file's order."""
    for tag, a, b in _chunks(data, start, end):
        if tag == b"rec ":
            yield from ((c, d) for kind, c, d in _chunks(data, a, b) if kind in names)
        elif tag in names:
            yield a, b


def parse_avi(data: bytes) -> dict:
    """frame_us, width, height, comment, frames of the first video stream. ValueError if it is none.

    An empty frame repeats the one before it (the first frame after it, at the start).
    """
    segments = list(_segments(data))
    if not segments:
        raise ValueError("not an AVI file")
    parts = segments[0]
    out = {"frame_us": 0, "width": 0, "height": 0, "comment": b"", "frames": []}
    head = parts.get(b"hdrl", (0, 0))
    for tag, start, end in _chunks(data, *head):
        if tag == b"avih" and end - start >= 40:
            out["frame_us"], out["width"], out["height"] = (struct.unpack_from("<I", data, start + o)[0] for o in (0, 32, 36))
    stream, lasts = _video_stream(data, head)
    out["frame_us"] = out["frame_us"] or lasts or FRAME_US
    for tag, start, end in _chunks(data, *parts.get(b"INFO", (0, 0))):
        if tag == b"ICMT":
            out["comment"] = data[start:end]
    if b"movi" not in parts:
        raise ValueError("no frames")
    names = (stream + b"dc", stream + b"db")
    first, last = parts[b"movi"]
    if b"idx1" in parts:
        start, end = parts[b"idx1"]
        entries = list(struct.iter_unpack("<4sIII", data[start : end - (end - start) % 16]))
        base = first - 4 if entries and entries[0][2] < first else 0  # offsets count from the list's kind, or from the file's start
        places = [(base + at + 8, base + at + 8 + n) for tag, _, at, n in entries if tag in names]
    else:
        places = list(_walk(data, first, last, names))
    for more in segments[1:]:
        places += _walk(data, *more.get(b"movi", (0, 0)), names)
    shown = next((p for p in places if p[0] < p[1]), None)
    for p in places if shown else ():
        shown = p if p[0] < p[1] else shown
        out["frames"].append(data[shown[0] : shown[1]])
    return out


# --- JPEG ---


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_head(across: int, down: int) -> bytes:
    one_code = bytes([1]) + bytes(15) + bytes([8])  # one code of one bit, for size 8
    return (
        b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([1]) * 64) + _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * down, 8 * across, 1, 1, 0x11, 0))
        + _segment(0xC4, bytes([0x00]) + one_code) + _segment(0xC4, bytes([0x10]) + one_code)
        + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def _spread(blocks: np.ndarray) -> np.ndarray:
    """(n, 64) bytes to (n, 72): a code bit 0 before each byte's eight bits."""
    b = blocks.reshape(-1, 8)
    out = np.zeros((len(b), 9), np.uint8)
    for j in range(9):
        if j < 8:
            out[:, j] = b[:, j] >> (j + 1)
        if j:
            out[:, j] |= (b[:, j - 1] & ((1 << j) - 1)) << (8 - j)
    return out.reshape(-1, 72)


def _gather(coded: np.ndarray) -> np.ndarray | None:
    """The inverse of ``_spread``; None if a code bit is not 0."""
    c = coded.reshape(-1, 9)
    if any((c[:, j] & (0x80 >> j)).any() for j in range(8)):
        return None
    out = np.empty((len(c), 8), np.uint8)
    for i in range(8):
        out[:, i] = ((c[:, i] & ((1 << (7 - i)) - 1)) << (i + 1)) | (c[:, i + 1] >> (7 - i))
    return out.reshape(-1, 64)


def encode_frames(blocks: np.ndarray, across: int, down: int) -> list[bytes]:
    """JPEG frames of across x down blocks each; ``blocks`` fills them."""
    coded = np.empty((len(blocks), 74), np.uint8)
    coded[:, :72] = _spread(blocks)
    each = across * down
    coded[:, 72], coded[:, 73] = 0xFF, 0xD0 + np.arange(len(blocks)) % each % 8
    coded[each - 1 :: each, 73] = 0xD9  # the frame's end in place of a restart
    stuffed = coded == 0xFF
    stuffed[:, 72:] = False
    sizes = 74 + stuffed.sum(axis=1)
    flat, twice = coded.ravel(), stuffed.ravel()
    out = np.repeat(flat, 1 + twice)
    at = np.flatnonzero(twice)
    out[at + 1 + np.arange(len(at))] = 0
    ends = np.cumsum(sizes)[each - 1 :: each]
    head, data = _frame_head(across, down), out.tobytes()
    return [head + data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


#: Fixed values, of the JPEG standard: how many codes have 1 to 16 bits, and the symbols in the order of their codes, for brightness and for
#: colour. Frames in AVI files may leave these tables out. All AC symbols that are not named follow in rising order.
DC_COUNTS = [[0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]]
AC_COUNTS = [[0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]]
AC_FIRST = [
    "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82",
    "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1",
]


def _code_table(counts: Iterable[int], symbols: bytes) -> dict[tuple[int, int], int]:
    """(bits, code) -> symbol: codes of one length are consecutive, and each length goes on from the one before."""
    code, at, table = 0, 0, {}
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            table[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def _standard_codes() -> dict[tuple[int, int], dict[tuple[int, int], int]]:
    out = {}
    for n in (0, 1):
        first = bytes.fromhex(AC_FIRST[n])
        every = {0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))}
        out[0, n] = _code_table(DC_COUNTS[n], bytes(range(12)))
        out[1, n] = _code_table(AC_COUNTS[n], first + bytes(sorted(every - set(first))))
    return out


STANDARD = _standard_codes()


class Header:
    """The tables of a JPEG frame up to its scan; ``at`` is where the scan's bits start."""

    def __init__(self, data: bytes):
        self.quant, self.codes, self.restart, self.parts, self.scan = {}, dict(STANDARD), 0, [], []
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        at = 2
        while True:
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("broken JPEG header")
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                self._quant(body)
            elif marker == 0xC4:
                self._codes(body)
            elif marker in (0xC0, 0xC1):
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC)):
                raise ValueError("only baseline frames are read")
            elif marker == 0xDD:
                self.restart = struct.unpack_from(">H", body)[0]
            elif marker == 0xDA:
                self.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                break
        self.at = at
        self.stored = self.restart == 1 and len(self.parts) == 1 and self.codes.get((0, 0)) == self.codes.get((1, 0)) == {(1, 0): 8} and self.quant.get(0) == [1] * 64

    def _quant(self, body: bytes) -> None:
        while body:
            wide, n = body[0] >> 4, body[0] & 15
            self.quant[n] = list(struct.unpack_from(">64H" if wide else ">64B", body, 1))
            body = body[129 if wide else 65 :]

    def _codes(self, body: bytes) -> None:
        while body:
            n = sum(body[1:17])
            self.codes[body[0] >> 4, body[0] & 15] = _code_table(body[1:17], body[17 : 17 + n])
            body = body[17 + n :]


def _bits(data: bytes) -> Iterator[int]:
    for byte in data:
        for i in range(7, -1, -1):
            yield byte >> i & 1


def _block(bits: Iterator[int], dc: dict, ac: dict, before: int) -> np.ndarray:
    def symbol(table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | next(bits)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("unknown code")

    def value(size: int) -> int:
        v = 0
        for _ in range(size):
            v = v << 1 | next(bits)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    out = np.zeros(64, np.int64)
    out[0] = before + value(symbol(dc))
    k = 1
    while k < 64:
        s = symbol(ac)
        run, size = s >> 4, s & 15
        if not size:
            if run < 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("too many coefficients")
        out[k] = value(size)
        k += 1
    return out


def _scan_parts(data: bytes) -> list[bytes]:
    """The scan's bits between restart markers, without stuffing."""
    parts, at, start = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        if data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            parts.append(data[start:at])
            at = start = at + 2
        else:
            break
    parts.append(data[start:at] if at >= 0 else data[start:])
    return [p.replace(b"\xff\x00", b"\xff") for p in parts]


def decode_jpeg(data: bytes) -> np.ndarray:
    """The samples of a baseline frame's first component (its brightness), height x width."""
    h = Header(data)
    wide, tall = max(p[1] for p in h.parts), max(p[2] for p in h.parts)
    across, down = -(-h.width // (8 * wide)), -(-h.height // (8 * tall))
    first = h.parts[0]
    out = np.zeros((down * first[2] * 8, across * first[1] * 8), np.uint8)
    tables = {p[0]: p for p in h.parts}
    parts = iter(_scan_parts(data[h.at :]))
    bits, before = iter(()), {}
    try:
        for mcu in range(across * down):
            if mcu == 0 or h.restart and mcu % h.restart == 0:
                bits, before = _bits(next(parts)), {}
            for name, dc, ac in h.scan:
                _, ph, pv, q = tables[name]
                for v in range(pv):
                    for u in range(ph):
                        c = _block(bits, h.codes[0, dc], h.codes[1, ac], before.get(name, 0))
                        before[name] = int(c[0])
                        if name == first[0]:
                            natural = np.zeros(64)
                            natural[ZIGZAG] = c * np.array(h.quant[q])
                            y, x = (mcu // across * pv + v) * 8, (mcu % across * ph + u) * 8
                            out[y : y + 8, x : x + 8] = pixels(natural[None])[0].reshape(8, 8)
    except (StopIteration, RuntimeError, KeyError) as e:
        raise ValueError("broken JPEG scan") from e
    return out[: -(-h.height * first[2] // tall), : -(-h.width * first[1] // wide)]


def stored_blocks(frames: list[bytes]) -> np.ndarray | None:
    """The bytes in frames that ``encode_frames`` wrote, (blocks, 64); None if a frame has another layout."""
    heads: dict[bytes, Header] = {}
    scans, blocks = [], 0
    for f in frames:
        start = f[: len(_frame_head(1, 1))]
        if start not in heads:
            try:
                heads[start] = Header(f)
            except ValueError:
                return None
        h = heads[start]
        if not h.stored or h.at != len(start):
            return None
        scans.append(f[h.at :])
        blocks += -(-h.width // 8) * -(-h.height // 8)
    a = np.frombuffer(b"".join(scans), np.uint8)
    mark = np.flatnonzero(a[:-1] == 0xFF)
    after = a[mark + 1]
    keep = np.ones(len(a), bool)
    keep[mark[after == 0] + 1] = False
    ends = mark[after >= 0xD0]
    keep[ends] = keep[ends + 1] = False
    coded = a[keep]
    return _gather(coded.reshape(-1, 72)) if len(coded) == 72 * blocks else None


def _as_coefficients(blocks: np.ndarray) -> np.ndarray:
    b = blocks.astype(np.int16)
    return np.where(b < 128, b - 255, b)


# --- shots ---


def histograms(frames: list[bytes], blocks: np.ndarray | None) -> np.ndarray:
    """(frames, LEVELS) counts of brightness; ``blocks`` spares decoding frames of the stored layout one by one."""
    if blocks is None:
        return np.stack([np.bincount(decode_jpeg(f).ravel() >> 4, minlength=LEVELS) for f in frames])
    each = len(blocks) // len(frames)
    light = np.concatenate([pixels(_as_coefficients(blocks[i : i + 4096]), _STORED_IDCT) >> 4 for i in range(0, len(blocks), 4096)])
    of = np.repeat(np.arange(len(frames)) * LEVELS, each * 64)
    return np.bincount(of + light.ravel(), minlength=len(frames) * LEVELS).reshape(-1, LEVELS)


def shots(counts: np.ndarray) -> list[int]:
    """The first frame of each shot: where a difference passes twice the mean of the last WINDOW ones and a twentieth of the frame."""
    size = int(counts[0].sum())
    differences = np.abs(np.diff(counts, axis=0)).sum(axis=1).tolist()
    starts, lately = [0], []
    for t, d in enumerate(differences, 1):
        if d * 20 > size and (not lately or d * len(lately) > 2 * sum(lately)):
            starts.append(t)
            lately = []
        lately = [*lately[-WINDOW + 1 :], d]
    return starts


def read_clips(data: bytes | None) -> list[tuple[int, int, int, int]]:
    """(clip, start_ms, end_ms, n_frames) of an AVI file; none if it is null or can't be read."""
    try:
        avi = parse_avi(data or b"")
        if not avi["frames"]:
            return []
        starts = [*shots(histograms(avi["frames"], stored_blocks(avi["frames"]))), len(avi["frames"])]
    except (ValueError, struct.error, IndexError):
        return []
    us = avi["frame_us"]
    return [(i, a * us // 1000, b * us // 1000, b - a) for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False))]


def clips(media: DataFrame, key: str = "media_id", column: str = "media") -> DataFrame:
    """A row per clip of each file: the key, clip, start_ms, end_ms, n_frames."""
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *c) for k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for c in read_clips(d)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[key, "clip", "start_ms", "end_ms", "n_frames"])

    return media.select(key, F.col(column).cast("binary").alias("media")).mapInArrow(run, f"{key} {kind}, clip int, start_ms long, end_ms long, n_frames int")


# --- texts as media ---


def store(text: bytes) -> bytes:
    """The text, with zeros up to a positive multiple of 64, as an AVI file."""
    n = max(1, -(-len(text) // UNIT))
    down = min(DOWN, -(-n // ACROSS))
    across = ACROSS if n >= ACROSS else n
    each = across * down
    payload = np.zeros((-(-n // each) * each, UNIT), np.uint8)
    payload.reshape(-1)[: len(text)] = np.frombuffer(text, np.uint8)
    return write_avi(encode_frames(payload, across, down), 8 * across, 8 * down, b"payload=%d" % (n * UNIT))


def load(data: bytes) -> tuple[bytes, np.ndarray, dict]:
    """What ``store`` stored, read from the file: the payload, its frames' histograms, and the parsed file."""
    avi = parse_avi(data)
    blocks = stored_blocks(avi["frames"])
    if blocks is None:
        raise ValueError("not a stored payload")
    size = int(avi["comment"].partition(b"=")[2])
    return blocks.tobytes()[:size], histograms(avi["frames"], blocks), avi


def _row(text: bytes) -> tuple:
    data = store(text)
    payload, counts, avi = load(data)
    starts = [*shots(counts), len(counts)]
    us = avi["frame_us"]
    timed = ",".join(f"{a * us // 1000}-{b * us // 1000}" for a, b in zip(starts, starts[1:], strict=False))
    feature = f"frames={len(counts)};shots={len(starts) - 1};levels={'.'.join(map(str, counts.sum(axis=0).tolist()))};clips_ms={timed}"
    return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature


_COLUMNS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for part, texts in slices(batch.column("text")):
            cols = zip(*map(_row, texts), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=_COLUMNS)


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and what the stored file gives back."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    kinds = ["long", "long", "long", "string", "long", "long", "string", "string"]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_report, ", ".join(f"{c} {k}" for c, k in zip(_COLUMNS, kinds, strict=True)))
