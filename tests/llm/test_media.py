import hashlib
import zlib

import numpy as np
import pytest

from inkstream.llm import media
from tests.llm.cases import by_id, documents, empty, texts


def test_every_text_comes_back(spark):
    stored = media.encode_media(documents(spark))
    rows = by_id(media.read_media(stored, n_bytes="n_bytes"))
    assert len(rows) == len(texts()) + 3
    for row in rows:
        raw = (texts()[row.doc_id] or "").encode() if row.doc_id is not None else b""
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (row.n_bytes, row.payload_bytes) == (len(raw), len(payload))
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert row.tail_crc32 == zlib.crc32(payload[-32:])
    assert len({r.media_sha256 for r in rows if r.doc_id in (6, 8)}) == 1


def test_empty_table(spark):
    assert media.read_media(media.encode_media(empty(spark)), n_bytes="n_bytes").collect() == []


@pytest.mark.parametrize("n", [576, 576 * 341, 576 * 400, 576 * 2000])
def test_sizes(n):
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    (data,) = media.encode_many([payload])
    image = media.parse(data)
    assert image.width % 8 == image.height % 8 == 0 and max(image.width, image.height) < 65_536
    assert media.decode_many([data])[0][0] == payload


def test_several_images_for_one_payload(monkeypatch):
    monkeypatch.setattr(media, "FRAME_BYTES", 576 * 2)
    payload = bytes(range(256)) * 9
    assert media.decode_many(media.encode_many([payload, payload[:576]])) [0][0] == payload


def test_feature_covers_every_image(monkeypatch):
    monkeypatch.setattr(media, "FRAME_BYTES", 576 * 2)
    one = bytes(range(256)) * 9
    other = one[:1152] + one[:1151:-1]
    a, b = (f for _, f in media.decode_many(media.encode_many([one, other])))
    assert a != b and a.split(",")[0] == b.split(",")[0] and len(a.split(",")) == 2


class Writer:
    """Bits of a scan, one symbol after another, to hold the decoder against."""

    def __init__(self):
        self.bits = ""

    def put(self, code: tuple[int, int], value: int = 0, size: int = 0) -> None:
        self.bits += format(code[0], f"0{code[1]}b")
        if size:
            self.bits += format(value if value >= 0 else value + (1 << size) - 1, f"0{size}b")

    def bytes(self) -> bytes:
        bits = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def _image(components, coefficients, wide, high, apart=False):
    """A JPEG without restart intervals: coefficients by block in scan order, each (component, dc difference, [(run, value)]);
    apart: a scan of its own for each component."""
    dc = (bytes([0] * 3 + [12] + [0] * 12), bytes(range(12)))
    symbols = [0x00, 0xF0, *[r << 4 | s for r in range(4) for s in range(1, 5)]]
    ac = (bytes([0] * 4 + [len(symbols)] + [0] * 11), bytes(symbols))
    dc_code = {s: (c, n) for c, n, s in media.canonical(list(dc[0]), list(dc[1]))}
    ac_code = {s: (c, n) for c, n, s in media.canonical(list(ac[0]), list(ac[1]))}
    def coded(blocks):
        w = Writer()
        for _, diff, runs in blocks:
            size = abs(diff).bit_length()
            w.put(dc_code[size], diff, size)
            for run, value in runs:
                size = abs(value).bit_length()
                w.put(ac_code[run << 4 | size], value, size)
            w.put(ac_code[0])
        return w.bytes()

    frame = bytes([8, high >> 8, high & 255, wide >> 8, wide & 255, len(components)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(components))
    n = len(components)
    scans = [([i], [x for x in coefficients if x[0] == i]) for i in range(n)] if apart else [(range(n), coefficients)]
    said = b"".join(media._segment(0xDA, bytes([len(c)]) + b"".join(bytes([i + 1, 0]) for i in c) + b"\0\x3f\0") + coded(x) for c, x in scans)
    return b"\xff\xd8" + media._segment(0xDB, b"\0" + bytes([16] * 64)) + media._segment(0xC0, frame) + media._segment(0xC4, b"\0" + dc[0] + dc[1]) + media._segment(0xC4, b"\x10" + ac[0] + ac[1]) + said + b"\xff\xd9"


def test_colour_image_with_ac_coefficients():
    # 2x2 luminance blocks and one of each colour in every MCU, two MCUs
    luma = [5, -3, 7, 1, -2, 4, 0, 6]
    blocks, at, pred = [], [], 0
    for m in range(2):
        for y in luma[4 * m : 4 * m + 4]:
            blocks.append((0, y, [(0, 3), (2, -1)]))
            pred += y
            at.append(pred)
        blocks += [(1, 2, []), (2, -2, [(1, 1)])]
    data = _image([(2, 2), (1, 1), (1, 1)], blocks, 32, 16)
    (thumb,) = media.thumbnails([media.parse(data)])
    level = lambda q: max(0, min(255, (q * 16 + 1028) >> 3))
    assert thumb.tolist() == [[level(at[i]) for i in (0, 1, 4, 5)], [level(at[i]) for i in (2, 3, 6, 7)]]


def test_what_is_no_baseline_image_is_refused():
    with pytest.raises(media.NotBaseline):
        media.parse(b"GIF89a")
    progressive = b"\xff\xd8" + media._segment(0xC2, b"\x08\0\x08\0\x08\x01\x01\x11\0")
    with pytest.raises(media.NotBaseline):
        media.parse(progressive)


def test_scans_of_single_components():
    # 2x2 luminance: in a scan of its own blocks go row by row over the whole component
    luma = [5, -3, 7, 1, -2, 4, 0, 6]
    blocks = [(0, y, [(0, 3)]) for y in luma] + [(1, 2, []), (1, -2, [(1, 1)])]
    data = _image([(2, 2), (1, 1)], blocks, 32, 16, apart=True)
    image = media.parse(data + b"trailing")
    (thumb,) = media.thumbnails([image])
    level = lambda q: max(0, min(255, (q * 16 + 1028) >> 3))
    sums = np.cumsum(luma)
    assert image.end == len(data) and thumb.tolist() == [[level(q) for q in sums[:4]], [level(q) for q in sums[4:]]]
    assert media.decode_many([data + b"trailing", data]) == [media.decode_many([data])[0]] * 2


def test_damaged_and_null_media_leave_the_other_rows_alone(spark):
    (good,) = media.encode_many([bytes(range(256)) * 9])
    found = [good, None, b"", b"GIF89a", good[:40], good + b"??", b"\xff\xd8", good[:200] + good[260:]]
    df = spark.createDataFrame(list(enumerate(found)), "doc_id long, media binary").coalesce(1)
    rows = by_id(media.read_media(df))
    assert len(rows) == len(found) and rows[0].payload_bytes == 2304
    assert [r.payload_sha256 == rows[0].payload_sha256 for r in rows][:7] == [True, False, False, False, False, True, False]
    assert rows[1].media_bytes is None and rows[1].feature is None
    assert rows[3].media_bytes == 6 and rows[3].feature is None and rows[3].payload_bytes is None


def _slow_hash(thumb):
    """Both hashes by loops over cells."""
    def cells(rows, cols):
        y = [min(i * len(thumb) // rows, len(thumb) - 1) for i in range(rows)]
        x = [min(j * len(thumb[0]) // cols, len(thumb[0]) - 1) for j in range(cols)]
        out = []
        for i in range(rows):
            below = max(y[i] + 1, y[i + 1] if i + 1 < rows else len(thumb))
            row = []
            for j in range(cols):
                right = max(x[j] + 1, x[j + 1] if j + 1 < cols else len(thumb[0]))
                part = [int(v) for line in thumb[y[i] : below] for v in line[x[j] : right]]
                row.append(64 * sum(part) // len(part))
            out.append(row)
        return out

    grid, wide = cells(8, 8), cells(8, 9)
    mean = sum(map(sum, grid)) // 64
    bits = ["".join("01"[v > mean] for row in grid for v in row), "".join("01"[row[j + 1] > row[j]] for row in wide for j in range(8))]
    return "".join(format(int(b, 2), "016x") for b in bits)


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (8, 8), (24, 24), (30, 11), (9, 40)])
def test_thumbnail_hash_cell_by_cell(shape):
    thumb = np.random.default_rng(shape[0] * 100 + shape[1]).integers(0, 256, shape, dtype=np.uint8)
    assert media.thumbnail_hash(thumb) == _slow_hash(thumb.tolist())
