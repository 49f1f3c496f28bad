"""Media columns: AVI files of motion JPEG.

``parse_avi`` walks the RIFF chunks and reads the frame index (idx1; without one, the movi list);
``decode_jpegs`` decodes baseline intra frames, all of a batch in step: each numpy operation moves
every frame on by one Huffman symbol. ``shots`` finds cuts where the difference of two frames'
brightness histograms stands out from the differences around it, and gives timed clips.

Storing bytes: ``encode_payload`` makes each 8-bit value one quantised coefficient, the unit that
JPEG keeps without loss (0-127 become -128..-1, 128-255 become 1..128): 576 of them are the nine
blocks of a 24 x 24 grey frame with a quantiser of ones. The cosine transform is computed in whole
numbers, so equal bytes give equal pixels and features everywhere.

Defined cases: null text is empty, and an empty text is one frame of padding; repeated rows are each
stored; an empty table gives no rows; other columns are not read; an AVI that is cut short yields
the frames that are whole; a frame that is no baseline JPEG raises ValueError with the reason.

A very long text is held whole by one task, with its frames; each row is stored by itself, so no
ties arise.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship_package

from .shared import buffers, runs

UNIT, SIDE = 576, 24
#: Payload bytes encoded or decoded at once.
SLICE = 1 << 20
#: The clock of stored payloads: frames a second.
RATE = 25

# --- fixed values of the JPEG standard (ITU T.81, annex K): code counts by length, then symbols ---
DC_LUMA = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12)))
DC_CHROMA = ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), tuple(range(12)))
AC_LUMA = (
    (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 0x7D),
    tuple(bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
        "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6"
        "c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa")),
)
AC_CHROMA = (
    (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 0x77),
    tuple(bytes.fromhex(
        "0001020311040521310612415107617113223281081442"
        "91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748"
        "494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3"
        "c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa")),
)


def _zigzag() -> np.ndarray:
    """Where the k-th coefficient of a scan lies in its block: diagonals, walked up and down in turn."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[1] if (x[0] + x[1]) % 2 == 0 else x[0]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


def _cosines() -> np.ndarray:
    """64 coefficients -> 64 samples, times 2**20 and rounded to whole numbers."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    one[0] /= np.sqrt(2)
    return np.round(np.kron(one, one) * (1 << 20))


_COSINES = _cosines()


def codes(table: tuple) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length)."""
    counts, symbols = table
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out[symbol] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


@lru_cache(64)
def _lookup(table: tuple) -> np.ndarray:
    """By the next 16 bits: symbol * 32 + code length; 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in codes(table).items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = symbol * 32 + length
    return out


# --- writing -----------------------------------------------------------------

def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def _frame_head() -> bytes:
    """All of a grey 24 x 24 frame before its coefficients; as is usual in AVI, the standard Huffman tables are left out."""
    return (
        b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
        + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


def _by_size(table: tuple) -> tuple[np.ndarray, np.ndarray]:
    found = codes(table)
    return np.array([found.get(s, (0, 0))[0] for s in range(12)], np.int64), np.array([found.get(s, (0, 0))[1] for s in range(12)], np.int64)


_SIZE = np.zeros(2048, np.int64)
for _s in range(1, 11):
    _SIZE[1 << (_s - 1) : 1 << _s] = _s
_HEAD = _frame_head()
_DC_CODE, _DC_LENGTH = _by_size(DC_LUMA)
_AC_CODE, _AC_LENGTH = _by_size(AC_LUMA)


def encode_frames(payload: np.ndarray) -> list[bytes]:
    """One JPEG for each 576 bytes."""
    n = len(payload) // UNIT
    value = payload.astype(np.int64).reshape(n, UNIT // 64, 64) - 128
    value += value >= 0
    value[:, 1:, 0] -= value[:, :-1, 0].copy()
    size = _SIZE[np.abs(value)]
    code, length = _AC_CODE[size], _AC_LENGTH[size]
    code[:, :, 0], length[:, :, 0] = _DC_CODE[size[:, :, 0]], _DC_LENGTH[size[:, :, 0]]
    bits = np.where(value < 0, value + (1 << size) - 1, value)
    code, length = ((code << size) | bits).reshape(n, UNIT), (length + size).reshape(n, UNIT)
    # after the last coefficient, ones up to a whole byte
    total = length.sum(1)
    pad = -total % 8
    code, length = np.concatenate([code, ((1 << pad) - 1)[:, None]], 1).ravel(), np.concatenate([length, pad[:, None]], 1).ravel()
    at = np.cumsum(length) - length
    word = code << (32 - (at & 7) - length)
    count = int((total + pad).sum()) // 8
    stream = np.zeros(count + 4)
    for i in range(4):
        stream += np.bincount((at >> 3) + i, (word >> (24 - 8 * i)) & 255, count + 4)
    stream = stream[:count].astype(np.uint8)
    # a byte 255 is followed by 0
    ones = np.flatnonzero(stream == 255)
    stream = np.insert(stream, ones + 1, 0).tobytes()
    ends = np.cumsum((total + pad) // 8)
    ends += np.searchsorted(ones, ends)
    ends = [0, *ends.tolist()]
    return [b"".join((_HEAD, stream[a:b], b"\xff\xd9")) for a, b in zip(ends, ends[1:])]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, rate: int = RATE) -> bytes:
    """An AVI 1.0 file of one video stream with an index."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, rate, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    parts, index, at = [b"movi"], [], 4
    for frame in frames:
        parts.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(parts[-1])
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"".join(parts)) + _chunk(b"idx1", b"".join(index)))


# --- reading -----------------------------------------------------------------

def parse_avi(data: bytes) -> tuple[dict, list[tuple[int, int]]]:
    """({width, height, rate}, [(offset, size) of each video frame]) from the index, or from the movi list where there is none."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    info, movi, index = {"width": 0, "height": 0, "rate": float(RATE)}, None, None
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if name == b"LIST":
                kind = data[body : body + 4]
                if kind == b"movi":
                    movi = (body, min(end, body + size))
                else:
                    todo.append((body + 4, min(end, body + size)))
            elif name == b"avih":
                us = struct.unpack_from("<I", data, body)[0]
                info["rate"] = 1e6 / us if us else info["rate"]
                info["width"], info["height"] = struct.unpack_from("<II", data, body + 32)
            elif name == b"idx1":
                index = (body, min(size, len(data) - body) // 16)
            at = body + size + (size & 1)
    if movi is None:
        return info, []
    if index and index[1]:
        rows = np.frombuffer(data, np.dtype([("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), index[1], index[0])
        rows = rows[np.isin(rows["name"], [b"00dc", b"00db"])]
        # offsets count from the list's type, or in some files from the start
        base = movi[0] if len(rows) and data[movi[0] + int(rows["at"][0]) :][:4] == rows["name"][0] else 0
        at, size = rows["at"].astype(np.int64) + base + 8, rows["size"].astype(np.int64)
        whole = at + size <= len(data)
        return info, list(zip(at[whole].tolist(), size[whole].tolist()))
    frames, at = [], movi[0] + 4
    while at + 8 <= movi[1]:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST":
            at += 12
            continue
        if name[2:] in (b"dc", b"db") and at + 8 + size <= len(data):
            frames.append((at + 8, size))
        at += 8 + size + (size & 1)
    return info, frames


class _Head:
    """What stands before a frame's coefficients."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        quant: dict[int, np.ndarray] = {}
        huff = {(0, 0): DC_LUMA, (1, 0): AC_LUMA, (0, 1): DC_CHROMA, (1, 1): AC_CHROMA}  # AVI frames may leave them out
        self.restart, at, parts = 0, 2, None
        while True:
            if at + 4 > len(data):
                raise ValueError("a frame ends before its scan")
            mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if mark == 0xDB:
                while body:
                    wide, n = body[0] >> 4, body[0] & 15
                    quant[n] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                    body = body[1 + 64 * (1 + wide) :]
            elif mark == 0xC4:
                while body:
                    n = sum(body[1:17])
                    huff[body[0] >> 4, body[0] & 15] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif mark in (0xC0, 0xC1):
                deep, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if deep != 8:
                    raise ValueError("samples are not of 8 bits")
                parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC2 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
                raise ValueError("not a baseline JPEG frame")
            elif mark == 0xDD:
                self.restart = struct.unpack(">H", body[:2])[0]
            elif mark == 0xDA:
                if parts is None or body[0] != len(parts):
                    raise ValueError("a scan must hold all components")
                tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                break
        self.size = at
        if len(parts) == 1:  # one component is never interleaved
            parts = [(parts[0][0], 1, 1, parts[0][3])]
        self.hmax, self.vmax = max(p[1] for p in parts), max(p[2] for p in parts)
        self.across, self.down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        self.luma = parts[0][1], parts[0][2]
        self.quant = quant[parts[0][3]]
        #: Of each block of an MCU: its component, its DC and its AC table.
        self.blocks = [(i, huff[0, tables[c] >> 4], huff[1, tables[c] & 15]) for i, (c, h, v, _) in enumerate(parts) for _ in range(h * v)]


_HEADS: dict[bytes, _Head] = {}


def _head(frame: bytes) -> _Head:
    if frame.startswith(_HEAD):
        key = _HEAD
    else:
        key = frame[: frame.index(b"\xff\xda") + 64] if b"\xff\xda" in frame else frame[:64]
    if key not in _HEADS:
        if len(_HEADS) > 100:
            _HEADS.clear()
        _HEADS[key] = _Head(frame)
    return _HEADS[key]


def _coefficients(head: _Head, scans: list[bytes]) -> np.ndarray:
    """Coefficients in scan order, [scan, MCU, block of the MCU, 64]; all scans have the same head."""
    mcus = head.across * head.down
    each = head.restart or mcus
    streams, todo = [], []
    for scan in scans:
        parts = [scan]
        if head.restart:
            parts, a = [], 0
            raw = np.frombuffer(scan, np.uint8)
            for m in np.flatnonzero((raw[:-1] == 255) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)).tolist():
                parts.append(scan[a:m])
                a = m + 2
            parts.append(scan[a:])
        for i in range(-(-mcus // each)):
            streams.append(parts[i] if i < len(parts) else b"")
            todo.append(min(each, mcus - i * each))
    raw = np.frombuffer(b"".join(x + b"\0" * 16 for x in streams), np.uint8)
    ends = np.cumsum([len(x) + 16 for x in streams])
    stuffed = np.flatnonzero((raw[:-1] == 255) & (raw[1:] == 0)) + 1
    begins = np.concatenate([[0], ends[:-1]])
    begins -= np.searchsorted(stuffed, begins)
    raw = np.delete(raw, stuffed)
    window = np.zeros(len(raw), np.uint64)
    for i in range(6):
        window[: len(raw) - i] |= raw[i:].astype(np.uint64) << np.uint64(56 - 8 * i)
    per, n = len(head.blocks), len(streams)
    tables = list(dict.fromkeys(t for _, d, a in head.blocks for t in (d, a)))
    look = np.concatenate([_lookup(t) for t in tables])
    dc, ac = (np.array([tables.index(b[i]) for b in head.blocks]) << 16 for i in (1, 2))
    out = np.zeros((sum(todo) * per, 64), np.int16)
    unit = (np.cumsum(todo) - todo) * per
    stop = unit + np.array(todo) * per
    first = unit.copy()
    bit, k, block = begins.astype(np.int64) * 8, np.zeros(n, np.int64), np.zeros(n, np.int64)
    lines = len(raw) - 1
    while len(unit):
        bits = window[np.minimum(bit >> 3, lines)] << (bit & 7).astype(np.uint64)
        got = look[np.where(k == 0, dc[block], ac[block]) + (bits >> np.uint64(48)).astype(np.int64)]
        length, symbol = got & 31, got >> 5
        if not length.all():
            raise ValueError("a frame's coefficients are damaged")
        size = symbol & 15
        low = (((bits << length.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)) >> (32 - size)
        value = np.where(low < (1 << size) >> 1, low - (1 << size) + 1, low)
        bit += length + size
        k += symbol >> 4
        has = (size > 0) & (k < 64)
        out[unit[has], k[has]] = value[has]
        k = np.where((size > 0) | (symbol == 0xF0) | (k == 0), k + 1, 64)
        full = k >= 64
        if full.any():
            unit += full
            k[full] = 0
            block[full] = (unit[full] - first[full]) % per
            live = unit < stop
            if not live.all():
                unit, stop, first, bit, k, block = (x[live] for x in (unit, stop, first, bit, k, block))
    # DC values are differences within a component of a stream
    grid = np.arange(len(out)) % per
    start = np.repeat((np.cumsum(todo) - todo) * per, np.array(todo) * per)
    for c in {b[0] for b in head.blocks}:
        own = np.flatnonzero(np.isin(grid, [i for i, b in enumerate(head.blocks) if b[0] == c]))
        total = np.cumsum(out[own, 0].astype(np.int64))
        before = np.searchsorted(own, start[own])
        out[own, 0] = total - np.where(before > 0, total[before - 1], 0)
    return out.reshape(len(scans), mcus, per, 64)


def decode_jpegs(frames: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(coefficients [MCU, block, 64] in scan order, brightness [height, width]) of each frame."""
    groups: dict[int, list[int]] = {}
    heads = [_head(f) for f in frames]
    for i, h in enumerate(heads):
        groups.setdefault(id(h), []).append(i)
    out: list = [None] * len(frames)
    for own in groups.values():
        head = heads[own[0]]
        got = _coefficients(head, [frames[i][head.size : -2 if frames[i].endswith(b"\xff\xd9") else None] for i in own])
        h, v = head.luma
        plain = np.zeros((got.shape[0], got.shape[1], h * v, 64))
        plain[..., ZIGZAG] = got[:, :, : h * v] * head.quant
        pixels = np.floor((plain.reshape(-1, 64) @ _COSINES + (128 * (1 << 20) + (1 << 19))) / (1 << 20)).clip(0, 255).astype(np.uint8)
        # blocks -> rows of pixels
        pixels = pixels.reshape(len(own), head.down, head.across, v, h, 8, 8).transpose(0, 1, 3, 5, 2, 4, 6)
        pixels = pixels.reshape(len(own), head.down * v * 8, head.across * h * 8)[:, : head.height, : head.width]
        for i, c, p in zip(own, got, pixels):
            out[i] = (c, p)
    return out


def histograms(pixels: np.ndarray, bins: int = 32) -> np.ndarray:
    """Shares of brightness bins of frames [frame, height, width]."""
    n, count = len(pixels), pixels[0].size if len(pixels) else 1
    flat = (pixels.reshape(n, -1).astype(np.int64) * bins >> 8) + np.arange(n)[:, None] * bins
    return np.bincount(flat.ravel(), minlength=n * bins).reshape(n, bins) / count


def shots(shares: np.ndarray, around: int = 8, factor: float = 1.5, least: float = 0.2) -> list[tuple[int, int]]:
    """[first, last) frames of each clip: a cut lies where the histogram difference is over ``least`` and over ``factor`` times the mean of up to ``around`` differences on either side."""
    if not len(shares):
        return []
    d = np.abs(np.diff(shares, axis=0)).sum(1) / 2
    total = np.concatenate([[0], np.cumsum(d)])
    at = np.arange(len(d))
    lo, hi = np.maximum(at - around, 0), np.minimum(at + around + 1, len(d))
    others = np.maximum(hi - lo - 1, 1)
    mean = (total[hi] - total[lo] - d) / others
    cuts = [0, *(np.flatnonzero((d > least) & (d > factor * mean)) + 1).tolist(), len(shares)]
    return list(zip(cuts, cuts[1:]))


def clips(data: bytes) -> list[dict]:
    """Timed clips of an AVI file: first_frame, last_frame, start_ms, end_ms, brightness."""
    info, spots = parse_avi(data)
    seen = [p for _, p in decode_jpegs([data[a : a + n] for a, n in spots])]
    if not seen:
        return []
    shares = np.concatenate([histograms(p[None]) for p in seen])
    ms = 1000 / info["rate"]
    return [{"first_frame": a, "last_frame": b - 1, "start_ms": round(a * ms), "end_ms": round(b * ms), "brightness": float(np.mean([seen[i].mean() for i in range(a, b)]))} for a, b in shots(shares)]


def detect_clips(media: DataFrame, *, id_col: str = "media_id", data_col: str = "media") -> DataFrame:
    """One row per clip of each AVI in a binary column; a null or empty file has none."""
    ship_package(media.sparkSession)
    kind = media.schema[id_col].dataType.simpleString()

    def found(batches):
        schema = None
        for batch in batches:
            schema = schema or pa.schema([(id_col, batch.schema.field(0).type), ("clip", pa.int32()), ("first_frame", pa.int64()), ("last_frame", pa.int64()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("brightness", pa.float64())])
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                rows = [{id_col: key, "clip": i} | c for i, c in enumerate(clips(data))] if data else []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return media.select(id_col, data_col).mapInArrow(found, f"{id_col} {kind}, clip int, first_frame long, last_frame long, start_ms long, end_ms long, brightness double")


def _described(files: list[bytes]) -> tuple[list[bytes], list[str]]:
    """Payload and feature of stored files, decoded in slices of whole frames."""
    frames, owner = [], []
    for i, data in enumerate(files):
        spots = parse_avi(data)[1]
        frames += [data[a : a + n] for a, n in spots]
        owner += [i] * len(spots)
    coefficients, shares, means = [], [], []
    for lo in range(0, len(frames), SLICE // UNIT):
        got = decode_jpegs(frames[lo : lo + SLICE // UNIT])
        values = np.stack([c for c, _ in got])
        pixels = np.stack([p for _, p in got])
        coefficients.append((values.reshape(len(got), UNIT) - (values.reshape(len(got), UNIT) > 0) + 128).astype(np.uint8))
        shares.append(histograms(pixels))
        means.append(pixels.reshape(len(got), -1).sum(1, dtype=np.int64))
    values, shares, means = np.concatenate(coefficients), np.concatenate(shares), np.concatenate(means)
    bounds = np.searchsorted(owner, np.arange(len(files) + 1)).tolist()
    payloads, features = [], []
    for a, b in zip(bounds, bounds[1:]):
        payloads.append(values[a:b].tobytes())
        found = shots(shares[a:b])
        features.append(f"frames={b - a};clips={len(found)};longest={max(y - x for x, y in found)};brightness={int(means[a:b].sum()) * 100 // ((b - a) * UNIT)}")
    return payloads, features


def store_texts(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each text, stored as AVI and read back."""
    ship_package(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def stored(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for lo, hi in runs(offsets, SLICE):
                sizes = np.diff(offsets[lo : hi + 1])
                padded = np.maximum(-(-sizes // UNIT), 1) * UNIT
                at = np.cumsum(padded) - padded
                payload = np.full(int(padded.sum()), 255, np.uint8)
                target = np.repeat(at - (offsets[lo:hi] - offsets[lo]), sizes) + np.arange(int(sizes.sum()))
                payload[target] = data[offsets[lo] : offsets[hi]]
                frames = []
                for a in range(0, len(payload), SLICE):
                    a, b = a // UNIT * UNIT, min(len(payload), (a + SLICE) // UNIT * UNIT) if a + SLICE < len(payload) else len(payload)
                    frames += encode_frames(payload[a:b])
                cut = (np.concatenate([at, [len(payload)]]) // UNIT).tolist()
                files = [write_avi(frames[a:b]) for a, b in zip(cut, cut[1:])]
                del frames
                payloads, features = _described(files)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array([len(x) for x in payloads], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in payloads]), pa.array([zlib.crc32(x[-32:]) for x in payloads], pa.int64()),
                        pa.array([len(x) for x in files], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in files]), pa.array(features),
                    ],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(stored, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
