import random
from collections import Counter

import numpy as np
import pytest

from inkstream.llm import repeats
from tests.llm.cases import by_id, documents, empty, plain, texts


def brute(found, length):
    raw = [(t or "").encode() for t in found]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        runs = [r for r in bytes(cover).split(b"\0") if r]
        out.append((len(b), kept, len(runs)))
    return out


def rows(df):
    return {r.doc_id: (r.n_bytes, bytes(r.kept), len(r.spans)) for r in df.collect()}


def mixed(seed, n=60):
    random.seed(seed)
    letters = "ab" if seed % 2 else "abcdefghij é"
    parts = ["".join(random.choice(letters) for _ in range(random.choice([5, 30, 60, 150]))) for _ in range(12)]
    return ["".join(random.choice(parts) if random.random() < 0.6 else random.choice(letters) for _ in range(random.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize(("seed", "hot"), [(0, 256), (1, 256), (2, 1), (3, 3)])
def test_matches_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SPREAD", 5)
    found = mixed(seed)
    got = rows(repeats.remove_repeats(plain(spark, list(enumerate(found))), length=40, prefix=12))
    assert [got[i] for i in range(len(found))] == brute(found, 40)


def test_pieces_of_long_texts(spark, monkeypatch):
    random.seed(9)
    passage = "".join(random.choice("abcdefghijklmnop") for _ in range(500))
    noise = lambda n: "".join(random.choice("qrstuvwxyz ") for _ in range(n))
    found = [noise(3000) + passage + noise(2000) + passage[100:400], noise(50) + passage[30:], passage[:199]]
    expected = brute(found, 200)
    monkeypatch.setattr(repeats, "PIECE_BYTES", 777)
    got = {}
    import pyarrow as pa

    for i, t in enumerate(found):
        batch = pa.RecordBatch.from_pydict({"_row": pa.array([i]), "text": pa.array([t])})
        got[i] = repeats._rows_of(batch, 200, 64, True)
    monkeypatch.undo()
    for i, t in enumerate(found):
        batch = pa.RecordBatch.from_pydict({"_row": pa.array([i]), "text": pa.array([t])})
        whole = repeats._rows_of(batch, 200, 64, True)
        windows = lambda r: {(int(a) >> 16) + k for a in r["at"] for k in range((int(a) & 255) + 1)}
        assert windows(got[i]) == windows(whole) == set(range(max(0, len(t) - 199)))
    assert [rows(repeats.remove_repeats(plain(spark, list(enumerate(found)))))[i] for i in range(3)] == expected


def test_odd_rows_with_repeated_and_null_ids(spark):
    docs = documents(spark)
    found = [*texts(), texts()[6], texts()[3], None]
    got = sorted((r.n_bytes, bytes(r.kept), len(r.spans)) for r in repeats.remove_repeats(docs).collect())
    assert got == sorted(brute(found, 200))
    assert repeats.remove_repeats(empty(spark)).collect() == []


def test_spans_are_those_removed(spark):
    for r in by_id(repeats.remove_repeats(documents(spark))):
        raw = (texts()[r.doc_id] or "").encode() if r.doc_id is not None else b""
        edges = [0, *(e for s in r.spans for e in s), len(raw)]
        assert bytes(r.kept) == b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def test_windows_of_equal_hash_are_compared_as_bytes(spark, monkeypatch):
    """With hashes that tell nothing apart beyond the first bytes, only bytes decide."""
    random.seed(5)
    start = "".join(random.choice("abcdefgh") for _ in range(90))
    middles = ["".join(random.choice("jklmnop") for _ in range(18)) for _ in range(9)]
    found = [start + m + start[::-1] for m in middles] + [start + middles[0] + start[::-1]]
    honest = repeats.rolling

    def weak(raw, size):
        out = honest(raw, min(size, 64))[: max(0, len(raw) - size + 1)]
        return out if size <= 64 else np.zeros_like(out)

    monkeypatch.setattr(repeats, "rolling", weak)
    import pyarrow as pa

    raw = [t.encode() for t in found]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] * 10), pa.array([1] * 10), pa.array(range(10)), pa.array([0] * 10), pa.array(raw, pa.binary())],
        schema=repeats._KIND,
    )
    (out,) = repeats._fine(iter([batch]), 198)
    assert sorted(out.column("_row").to_pylist()) == [0, 9]


def test_radix_passes_find_equal_windows():
    rng = np.random.default_rng(3)
    for length in (1, 5, 8, 11, 16, 24):
        raw = rng.integers(97, 99, 400).astype(np.uint8)
        place = np.arange(len(raw) - length + 1)
        group = rng.integers(0, 3, len(place))
        count = Counter((g, raw[p : p + length].tobytes()) for p, g in zip(place, group, strict=True))
        expected = [count[g, raw[p : p + length].tobytes()] > 1 for p, g in zip(place, group, strict=True)]
        assert repeats.equal_windows(raw, place, group, length).tolist() == expected


def test_one_passage_in_very_many_surroundings(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 8)
    random.seed(8)
    noise = lambda n: "".join(random.choice("abcdefghijklmnop ") for _ in range(n))
    passage = noise(203)
    found = [noise(random.randint(0, 300)) + passage[random.randint(0, 4) :] + noise(random.randint(0, 300)) for _ in range(60)]
    got = rows(repeats.remove_repeats(plain(spark, list(enumerate(found)))))
    assert [got[i] for i in range(60)] == brute(found, 200)
