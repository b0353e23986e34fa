import hashlib

from pyspark.sql import functions as F

from inkstream.llm import shards
from tests.llm.cases import by_id, documents, empty, plain, texts


def bits(group, key):
    part = lambda v, n: int(hashlib.md5(("" if v is None else str(v)).encode()).hexdigest()[: n // 4], 16)
    return format(part(group, 16) << 40 | part(key, 40), "056b")


def brute(rows, limit):
    """Splits one bucket after another, a bit at a time."""
    out, todo = {}, [("", rows)]
    while todo:
        prefix, own = todo.pop()
        size = sum(n for _, n, _ in own)
        if size <= limit or len(own) == 1:
            for k, n, h in own:
                out[k] = (n, prefix, size, len(own))
            continue
        for b in "01":
            if part := [r for r in own if r[2].startswith(prefix + b)]:
                todo.append((prefix + b, part))
    return out


def test_matches_splitting_one_bit_at_a_time(spark):
    rows = [(i, "x" * (i * 37 % 900)) for i in range(400)]
    docs = plain(spark, rows)
    for limit in (2_000, 30_000, 10**9):
        expected = brute([(i, len(t), bits(f"src{i % 3}", i)) for i, t in rows], limit)
        got = {r.doc_id: (r.n_bytes, r.shard, r.shard_bytes, r.shard_rows) for r in shards.assign_shards(docs, limit).collect()}
        assert got == expected
        assert all(r.fits and r.shard_bytes <= limit for r in shards.assign_shards(docs, limit).collect())


def test_large_directories_are_shuffled(spark, monkeypatch):
    docs = plain(spark, [(i, "x" * 100) for i in range(200)])
    small = sorted(map(tuple, shards.assign_shards(docs, 500).collect()))
    monkeypatch.setattr(shards, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, shards.assign_shards(docs, 500).collect())) == small


def test_odd_rows(spark):
    rows = by_id(shards.assign_shards(documents(spark), 1_000))
    assert len(rows) == len(texts()) + 3
    assert {r.n_bytes for r in rows if r.doc_id == 15} == {len(texts()[15].encode())}
    assert [(r.fits, r.shard_rows) for r in rows if r.doc_id == 11] == [(False, 1)]  # alone, and over the limit
    assert all(r.fits or r.shard_rows == 1 for r in rows)
    assert shards.assign_shards(empty(spark), 1_000).collect() == []


def test_repeated_keys_are_parted(spark):
    rows = shards.assign_shards(plain(spark, [(1, "x" * 600)] * 40), 2_000).collect()
    assert len(rows) == 40 and all(r.fits and r.depth > 56 for r in rows)
    count = {r.shard: r.shard_rows for r in rows}
    assert sum(count.values()) == 40 and max(count.values()) <= 3


def test_shards_are_written(spark, tmp_path):
    docs = plain(spark, [(i, "x" * 100) for i in range(50)])
    assert shards.write_shards(docs, str(tmp_path / "out"), 1_000) == "shard"
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50
    assert all(r.b <= 1_000 for r in back.groupBy("shard").agg(F.sum(F.length("text")).alias("b")).collect())


def test_every_row_is_written_once(spark, tmp_path):
    """Repeated and null ids, and a column that is called as the partitions' one."""
    docs = documents(spark).withColumnRenamed("n_bytes", "Shard")
    assert shards.write_shards(docs, str(tmp_path / "out"), 1_000) == "shard_"
    back = spark.read.parquet(str(tmp_path / "out"))
    names = back.columns
    assert names[:2] == ["doc_id", "text"] and "TEXT_2" in names and names[-1] == "shard_"
    got = sorted((r[0] is None, r[0] or 0, r[1] or "") for r in back.collect())
    assert got == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in docs.collect())
    assert len(got) == len(texts()) + 3
    shards.write_shards(empty(spark), str(tmp_path / "none"), 1_000)
