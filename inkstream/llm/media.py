"""Operator 1, media columns: bytes in baseline JPEG and back, dimensions and DC-only thumbnails.

A JPEG of flat 8x8 blocks carries one byte per block: with a DC quantiser of 8, sample v has the quantised DC
coefficient v - 128, so the DC-only luminance thumbnail is the stored bytes, without loss. Every block row of 24
blocks is a restart interval; the decoder follows all intervals of a batch side by side in numpy. It reads any
baseline JPEG (several components in one scan or in scans of their own, AC coefficients, with or without restart
intervals); bytes behind an image that open no further one are passed over.

Null and empty texts are 576 bytes of 255. Repeated rows give repeated rows, and equal texts equal media. Long
payloads take wider images, and beyond FRAME_BYTES several images one after another. On reading, null media and media
that are no baseline JPEG give null features, and the other rows of the table their own. Empty tables give empty ones;
further columns may have any names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkstream.llm.common import map_slices, project, utf8

UNIT = 576
LANE = 24
FRAME_BYTES = 24 * 24 * 60_000
MAX_BLOCKS = 65_535 // 8
#: Bytes handled side by side: arrays of some MB, which stay in a core's cache.
STEP_BYTES = 1 << 18
#: DC code lengths by category 0..8; the AC table has the end of block alone.
DC_LENGTHS = {0: 4, 1: 4, 8: 4, 2: 3, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3}


class NotBaseline(ValueError):
    """The bytes are not a baseline JPEG that can be read."""


def canonical(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(code, length, symbol) of a table as DHT gives it: how many codes of each length, then the symbols in order."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length, symbols[k]))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _dht(lengths: dict[int, int]) -> tuple[list[int], list[int]]:
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return [sum(v == n for v in lengths.values()) for n in range(1, 17)], symbols


def _diff_codes() -> tuple[np.ndarray, np.ndarray]:
    """By DC difference + 255: the bits of category, magnitude and end of block, and how many they are."""
    by = {s: (c, n) for c, n, s in canonical(*_dht(DC_LENGTHS))}
    codes, sizes = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        code, n = by[cat]
        mag = d if d >= 0 else d + (1 << cat) - 1
        codes[d + 255], sizes[d + 255] = ((code << cat) | mag) << 1, n + cat + 1
    return codes, sizes


_CODES, _SIZES = _diff_codes()
_DC, _AC = (bytes(n) + bytes(s) for n, s in (_dht(DC_LENGTHS), _dht({0: 1})))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(n_bytes: int, wide: int, high: int) -> bytes:
    quant = bytes([8]) + bytes([1]) * 63
    return (
        b"\xff\xd8"
        + _segment(0xFE, b"payload=%d" % n_bytes)
        + _segment(0xDB, b"\0" + quant)
        + _segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 1) + b"\x01\x11\x00")
        + _segment(0xC4, b"\x00" + _DC)
        + _segment(0xC4, b"\x10" + _AC)
        + _segment(0xDD, struct.pack(">H", LANE))
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def encode_lanes(lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of restart intervals (rows of LANE samples), and where each interval's bytes end.

    An RST marker's two bytes follow each interval; its number counts from 0 in the first row given.
    """
    q = lanes.astype(np.int64)
    index = np.empty_like(q)
    index[:, 0] = q[:, 0] - 128
    np.subtract(q[:, 1:], q[:, :-1], out=index[:, 1:])
    index += 255
    code, size = _CODES[index], _SIZES[index]
    n = len(lanes)
    words = np.zeros((n, 6), np.uint64)
    flat, base = words.reshape(-1), np.arange(n) * 6
    at = np.zeros(n, np.int64)
    for k in range(0, LANE, 4):
        c, s = code[:, k], size[:, k].copy()
        for j in range(k + 1, k + 4):
            c = (c << size[:, j].astype(np.uint64)) | code[:, j]
            s += size[:, j]
        over = (at & 63) + s - 64
        w = base + (at >> 6)
        spill = over > 0
        flat[w] |= np.where(spill, c >> np.maximum(over, 0).astype(np.uint64), c << np.maximum(-over, 0).astype(np.uint64))
        flat[w[spill] + 1] |= c[spill] << (64 - over[spill]).astype(np.uint64)
        at += s
    grid = words.byteswap().view(np.uint8).reshape(n, 48)
    used = (at + 7) >> 3
    rest = at & 7
    rows = np.flatnonzero(rest)
    grid[rows, used[rows] - 1] |= (0xFF >> rest[rows]).astype(np.uint8)
    body = grid[np.arange(48) < used[:, None]]
    ff = body == 255
    width = 1 + ff.astype(np.int64)
    stuffed = np.cumsum(width)
    ends = stuffed[np.cumsum(used) - 1] + 2 * np.arange(1, n + 1)
    place = stuffed - width + 2 * np.repeat(np.arange(n), used)
    out = np.zeros(int(ends[-1]), np.uint8)
    out[place] = body
    out[ends - 2] = 255
    out[ends - 1] = 0xD0 + (np.arange(n) & 7)
    return out, ends


def _shape(n: int) -> tuple[int, int]:
    """Blocks across (a multiple of LANE) and down, for n samples."""
    wide = LANE * max(1, -(-n // (LANE * MAX_BLOCKS)))
    return wide, -(-n // wide)


def payload_of(text: bytes) -> bytes:
    """The text with bytes 255 appended up to a positive multiple of UNIT."""
    return text + b"\xff" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """Each payload as JPEG bytes (several images if longer than FRAME_BYTES)."""
    frames, owner = [], []
    for i, p in enumerate(payloads):
        for k in range(0, max(1, len(p)), FRAME_BYTES):
            frames.append(p[k : k + FRAME_BYTES])
            owner.append(i)
    shapes = [_shape(len(f)) for f in frames]
    padded = b"".join(f + b"\xff" * (w * h - len(f)) for f, (w, h) in zip(frames, shapes, strict=True))
    body, ends = encode_lanes(np.frombuffer(padded, np.uint8).reshape(-1, LANE))
    out: list[list[bytes]] = [[] for _ in payloads]
    lane = 0
    for f, (w, h), i in zip(frames, shapes, owner, strict=True):
        n = w * h // LANE
        start, stop = int(ends[lane - 1]) if lane else 0, int(ends[lane + n - 1]) - 2
        scan = body[start:stop]
        if lane & 7:  # markers count from 0 in each image
            scan = scan.copy()
            marks = ends[lane : lane + n - 1] - 1 - start
            scan[marks] = 0xD0 + (np.arange(n - 1) & 7)
        out[i] += [_header(len(f), w, h), scan.tobytes(), b"\xff\xd9"]
        lane += n
    return [b"".join(x) for x in out]


@dataclass
class Jpeg:
    """What the markers of one image say, and its scan without byte stuffing."""

    width: int = 0
    height: int = 0
    quant: dict[int, int] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)
    scan_parts: list[tuple[int, int, int]] = field(default_factory=list)
    interval: int = 0
    comment: bytes = b""
    scan: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    end: int = 0


def _entropy(data: bytes, at: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Coded bytes of the scan at a place without stuffing and restart markers, where its intervals start, and the place
    of the marker that ends it."""
    raw = np.frombuffer(data, np.uint8, offset=at)
    ff = np.flatnonzero(raw[:-1] == 255) if len(raw) else np.zeros(0, np.int64)
    after = raw[ff + 1]
    stop = ff[(after != 0) & (after != 255) & ((after < 0xD0) | (after > 0xD7))]
    end = int(stop[0]) if len(stop) else len(raw)
    ff, after = ff[ff < end], after[ff < end]
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(end, bool)
    keep[ff[after == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    return raw[:end][keep], np.concatenate([[0], np.cumsum(keep)[marks]]).astype(np.int64), at + end


def parse(data: bytes, at: int = 0) -> Jpeg:
    """Markers of the image that starts at a place, and the scan that holds its luminance; raises NotBaseline."""
    if data[at : at + 2] != b"\xff\xd8":
        raise NotBaseline("no SOI marker")
    out, at = Jpeg(), at + 2
    quant: dict[int, int] = {}
    tables: dict[int, bytes] = {}
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if data[at : at + 2] == b"\xff\xd9" or out.scan_parts and at >= len(data):
            out.end = at + 2
            break
        if len(data) < at + 4 or data[at] != 0xFF:
            raise NotBaseline("markers end early")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = 2 if body[k] >> 4 else 1
                quant[body[k] & 15] = int.from_bytes(body[k + 1 : k + 1 + wide], "big")
                k += 1 + 64 * wide
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                tables[body[k]] = bytes(body[k + 1 : k + 17 + n])
                k += 17 + n
        elif marker == 0xC0 or marker == 0xC1:
            depth, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise NotBaseline("samples are not 8 bits")
            out.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise NotBaseline("not a baseline scan")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
            out.interval = out.interval if out.scan_parts else interval
        elif marker == 0xFE:
            out.comment = bytes(body)
        elif marker == 0xDA:
            parts = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            scan, starts, at = _entropy(data, at)
            if not out.scan_parts and (not out.parts or out.parts[0][0] in {c for c, _, _ in parts}):
                out.scan_parts, out.scan, out.starts = parts, scan, starts
                out.quant, out.tables = dict(quant), dict(tables)
    if not out.scan_parts:
        raise NotBaseline("luminance is in no scan")
    return out


def _symbol_lut(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: the symbol and its code's length (0: no code)."""
    n = list(table[:16])
    symbol, length = np.zeros(65_536, np.int64), np.zeros(65_536, np.int64)
    for code, size, s in canonical(n, list(table[16:])):
        lo = code << (16 - size)
        symbol[lo : lo + (1 << (16 - size))] = s
        length[lo : lo + (1 << (16 - size))] = size
    return symbol, length


def _flat_lut(dc: bytes, ac: bytes) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: DC difference and bits used of a block with no AC coefficient (0 bits: not such a block)."""
    symbol, length = _symbol_lut(dc)
    ends, end_size = _symbol_lut(ac)
    peek = np.arange(65_536)
    room = 16 - length - symbol
    mag = (peek >> np.maximum(room, 0)) & ((1 << symbol) - 1)
    diff = np.where(symbol == 0, 0, np.where(mag >> np.maximum(symbol - 1, 0), mag, mag - (1 << symbol) + 1))
    rest = (peek << (length + symbol)) & 0xFFFF
    known = (length > 0) & (end_size[rest] > 0) & (ends[rest] == 0) & (room >= end_size[rest])
    return np.where(known, diff, 0), np.where(known, length + symbol + end_size[rest], 0)


_LUTS: dict[bytes, tuple] = {}


def _lut(kind, *tables: bytes) -> tuple:
    key = kind.__name__.encode() + b"".join(tables)
    if key not in _LUTS:
        if len(_LUTS) > 64:
            _LUTS.clear()
        _LUTS[key] = kind(*tables)
    return _LUTS[key]


class _Bits:
    """Peeks at bit places of many lanes that share one buffer."""

    def __init__(self, data: np.ndarray):
        wide = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.uint32)
        self.window = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
        self.last = len(self.window) - 1

    def peek16(self, at: np.ndarray) -> np.ndarray:
        return (self.window[np.minimum(at >> 3, self.last)] >> (16 - (at & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF


def _block(bits: _Bits, at: np.ndarray, dc: bytes, ac: bytes) -> np.ndarray:
    """The next block's DC difference in each lane; moves the places on."""
    diff, used = _lut(_flat_lut, dc, ac)
    peek = bits.peek16(at)
    out, step = diff[peek], used[peek]
    at += step
    odd = np.flatnonzero(step == 0)
    if len(odd):
        symbol, length = _lut(_symbol_lut, dc)
        ac_symbol, ac_length = _lut(_symbol_lut, ac)
        here = at[odd]
        peek = bits.peek16(here)
        if not length[peek].all():
            raise NotBaseline("a code is in no table")
        s = symbol[peek]
        here += length[peek]
        mag = bits.peek16(here) >> (16 - s)
        out[odd] = np.where(s == 0, 0, np.where(mag >> np.maximum(s - 1, 0), mag, mag - (1 << s) + 1))
        here += s
        k, live = np.ones(len(odd), np.int64), np.arange(len(odd))
        while len(live):
            peek = bits.peek16(here[live])
            if not ac_length[peek].all():
                raise NotBaseline("a code is in no table")
            rs = ac_symbol[peek]
            here[live] += ac_length[peek] + (rs & 15)
            k[live] += (rs >> 4) + 1
            live = live[(rs != 0) & (k[live] < 64)]
        at[odd] = here
    return out


def thumbnails(images: list[Jpeg]) -> list[np.ndarray]:
    """DC-only luminance thumbnails, one sample per 8x8 block; images of the same tables and layout go side by side."""
    out: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(images)
    groups: dict[tuple, list[int]] = {}
    for i, x in enumerate(images):
        if not x.parts or not x.width or not x.height:
            raise NotBaseline("no frame before the scan")
        groups.setdefault((tuple(sorted(x.tables.items())), tuple(x.parts), tuple(x.scan_parts), x.interval), []).append(i)
    for (tables, parts, scan_parts, interval), members in groups.items():
        by, tabs = {p[0]: p for p in parts}, dict(tables)
        if parts[0][0] not in {c for c, _, _ in scan_parts}:
            raise NotBaseline("luminance is not in the first scan")
        alone = len(scan_parts) == 1
        order = []
        for c, d, a in scan_parts:
            if d not in tabs or a + 16 not in tabs:
                raise NotBaseline("a table is missing")
            h, v = (1, 1) if alone else by[c][1:3]
            order += [(c, d, a, x, y) for y in range(v) for x in range(h)]
        top_h, top_v = max(p[1] for p in parts), max(p[2] for p in parts)
        luma = by[parts[0][0]]
        lanes, dims = [], []
        base = 0
        for i in members:
            x = images[i]
            if alone:
                across, down = -(-(-(-x.width * luma[1] // top_h)) // 8), -(-(-(-x.height * luma[2] // top_v)) // 8)
            else:
                across, down = -(-x.width // (8 * top_h)), -(-x.height // (8 * top_v))
            total = across * down
            step = interval or total
            n = -(-total // step)
            if len(x.starts) < n:
                raise NotBaseline("restart markers are missing")
            lanes.append(np.stack([base + x.starts[:n], np.minimum(step, total - step * np.arange(n))], 1))
            dims.append((across, down, step, n))
            base += len(x.scan)
        place = np.concatenate(lanes)
        bits = _Bits(np.concatenate([images[i].scan for i in members]))
        at, todo = place[:, 0] * 8, place[:, 1]
        longest = int(todo.max())
        here = [(k, o) for k, o in enumerate(order) if o[0] == luma[0]]
        seen = np.zeros((len(place), longest, len(here)), np.int32)
        pred = {c: np.zeros(len(place), np.int64) for c, _, _ in scan_parts}
        ragged = int(todo.min()) < longest
        for m in range(longest):
            live = np.flatnonzero(todo > m) if ragged else slice(None)
            j = 0
            for c, d, a, _, _ in order:
                spot = at[live]
                diff = _block(bits, spot, tabs[d], tabs[a + 16])
                at[live] = spot
                pred[c][live] += diff
                if c == luma[0]:
                    seen[live, m, j] = pred[c][live]
                    j += 1
        lane = 0
        for i, (across, down, step, n) in zip(members, dims, strict=True):
            q = images[i].quant.get(luma[3])
            if not q:
                raise NotBaseline("a quantiser is missing")
            dc = seen[lane : lane + n, :step].reshape(n * step, -1)[: across * down]
            lane += n
            value = np.clip((dc * q + 4 + 1024) >> 3, 0, 255).astype(np.uint8)
            h, v = (1, 1) if alone else luma[1:3]
            grid = value.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            rows, cols = -(-(-(-images[i].height * luma[2] // top_v)) // 8), -(-(-(-images[i].width * luma[1] // top_h)) // 8)
            out[i] = grid[:rows, :cols]
    return out


def _small(thumb: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean of each cell of a rows x cols grid laid over the thumbnail."""
    y = np.minimum(np.arange(rows) * thumb.shape[0] // rows, thumb.shape[0] - 1)
    x = np.minimum(np.arange(cols) * thumb.shape[1] // cols, thumb.shape[1] - 1)
    sums = np.add.reduceat(np.add.reduceat(thumb, y, axis=0, dtype=np.int64), x, axis=1)
    n = np.outer(np.maximum(np.diff(np.append(y, thumb.shape[0])), 1), np.maximum(np.diff(np.append(x, thumb.shape[1])), 1))
    return sums * 64 // n


def thumbnail_hash(thumb: np.ndarray) -> str:
    """Average hash and difference hash of a thumbnail, 16 hex digits each."""
    grid = _small(thumb, 8, 8)
    mean = grid.sum() // 64
    wide = _small(thumb, 8, 9)
    return "".join(np.packbits(b.reshape(-1)).tobytes().hex() for b in (grid > mean, wide[:, 1:] > wide[:, :-1]))


def decode_many(media: list[bytes]) -> list[tuple[bytes, str]]:
    """Of each media value: the payload read back, and the feature 'WxH:hash' of each of its images, joined by commas."""
    images, owner = [], []
    for i, data in enumerate(media):
        at = 0
        while not at or data[at : at + 2] == b"\xff\xd8":
            images.append(parse(data, at))
            owner.append(i)
            at = images[-1].end
    thumbs = thumbnails(images)
    payloads: list[list[bytes]] = [[] for _ in media]
    features: list[list[str]] = [[] for _ in media]
    for x, thumb, i in zip(images, thumbs, owner, strict=True):
        flat = thumb.tobytes()
        payloads[i].append(flat[: int(x.comment[8:])] if x.comment.startswith(b"payload=") else flat)
        features[i].append(f"{x.width}x{x.height}:{thumbnail_hash(thumb)}")
    return [(b"".join(p), ",".join(f)) for p, f in zip(payloads, features, strict=True)]


def _decode_each(media: list[bytes]) -> list[tuple[bytes, str] | None]:
    """As decode_many, with None for values that cannot be read."""
    try:
        return list(decode_many(media))
    except (NotBaseline, struct.error, IndexError, ValueError):
        if len(media) == 1:
            return [None]
        return [x for m in media for x in _decode_each([m])]


def encode_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: the key, the text's unpadded length and the JPEG bytes that hold it. No shuffle."""
    rows = project(df, key=key, text=text)

    def kernel(batch: pa.RecordBatch) -> dict:
        raw, at = utf8(batch.column("text"))
        whole = raw.tobytes()
        media = encode_many([payload_of(whole[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
        return {"key": batch.column("key"), "n_bytes": np.diff(at), "media": media}

    return map_slices(rows, kernel, f"key {dict(rows.dtypes)['key']}, n_bytes long, media binary", limit=STEP_BYTES).withColumnRenamed("key", key)


def read_media(df: DataFrame, key: str = "doc_id", media: str = "media", n_bytes: str | None = None) -> DataFrame:
    """Features of stored JPEG bytes: payload digests, dimensions and thumbnail hash. Null media give nulls; media
    that cannot be read give their own digest, and null features."""
    wanted = {"key": key, "media": media} | ({"n_bytes": n_bytes} if n_bytes else {})
    rows = project(df, **wanted)

    def kernel(batch: pa.RecordBatch) -> dict:
        stored = batch.column("media").to_pylist()
        read = iter(_decode_each([x for x in stored if x is not None]))
        back = [None if x is None else next(read) for x in stored]
        of = lambda f: [None if x is None else f(x) for x in back]
        out = {
            "key": batch.column("key"),
            "payload_bytes": of(lambda x: len(x[0])),
            "payload_sha256": of(lambda x: hashlib.sha256(x[0]).hexdigest()),
            "tail_crc32": of(lambda x: zlib.crc32(x[0][-32:])),
            "media_bytes": [None if x is None else len(x) for x in stored],
            "media_sha256": [None if x is None else hashlib.sha256(x).hexdigest() for x in stored],
            "feature": of(lambda x: x[1]),
        }
        return out | ({"n_bytes": batch.column("n_bytes")} if n_bytes else {})

    schema = f"key {dict(rows.dtypes)['key']}, " + "n_bytes long, " * bool(n_bytes) + "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_slices(rows, kernel, schema, text="media", limit=STEP_BYTES).withColumnRenamed("key", key)
