import datetime as dt

import pytest
from pyspark.sql import functions as F

from inkstream.operators import loader
from inkstream.sources import responses
from inkstream.streaming import crawl

T0 = dt.datetime(2024, 1, 1)
KIND = "url string, status int, etag string, modified string, body binary, saved_at timestamp, host string"


def _batch(spark, n, hosts=("a.example", "b.example:8080")):
    rows = [(f"http://{h}/{n}/{i}", 200, f"e{i}", None, b"x" * i, T0 + dt.timedelta(hours=10 * n + i), h) for h in hosts for i in range(3)]
    return spark.createDataFrame(rows, KIND).coalesce(1)


@pytest.fixture
def saved(spark, tmp_path):
    path = str(tmp_path / "web")
    for n in range(3):
        responses.save(_batch(spark, n), path, n)
    return path


def test_all_rows_come_back(spark, saved):
    found = responses.read(spark, saved)
    assert found.count() == 18
    row = found.filter("url = 'http://b.example:8080/1/2'").first()
    assert (row.host, row.batch, row.body, row.etag, row.saved_at) == ("b.example:8080", 1, b"xx", "e2", T0 + dt.timedelta(hours=12))


def test_a_partition_for_each_host_and_options(spark, saved):
    assert responses.read(spark, saved).rdd.getNumPartitions() == 6
    of = responses.read(spark, saved, host="a.example", since="2024-01-01T10:00:00", until="2024-01-01T20:00:00")
    assert of.rdd.getNumPartitions() == 3
    assert sorted(r.url for r in of.collect()) == ["http://a.example/1/0", "http://a.example/1/1", "http://a.example/1/2", "http://a.example/2/0"]


def test_filters_are_pushed(spark, saved):
    found = responses.read(spark, saved).filter((F.col("host") == "a.example") & (F.col("batch") == 2) & (F.col("saved_at") > T0 + dt.timedelta(hours=20)))
    assert found.rdd.getNumPartitions() == 1
    assert sorted(r.url for r in found.collect()) == ["http://a.example/2/1", "http://a.example/2/2"]
    assert responses.read(spark, saved).filter("host = 'a.example' and host = 'c.example'").count() == 0


def test_empty_folder(spark, tmp_path):
    assert responses.read(spark, str(tmp_path / "none")).collect() == []


def test_a_stream_reads_each_batch_once(spark, saved, tmp_path):
    def run():
        crawl.finish(responses.read_stream(spark, saved), str(tmp_path / "log"), lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={n}")))
        return sorted(r.url for r in spark.read.schema("url string").parquet(str(tmp_path / "out")).collect())

    once = run()
    assert len(once) == len(set(once)) == 18
    responses.save(_batch(spark, 4), saved, 4)  # a gap: not yet
    assert run() == once
    responses.save(_batch(spark, 3), saved, 3)
    assert len(run()) == len(set(run())) == 30


CACHE = "url string, status int, etag string, modified string, body binary, saved_at timestamp"


def test_rules_of_the_loader(spark):
    now = dt.datetime(2024, 3, 1)
    ago = lambda s: now - dt.timedelta(seconds=s)
    cached = [
        ("fresh", 200, "e", "m", b"c", ago(299)), ("failed", 404, None, None, b"", ago(10)), ("same", 200, "e", "m", b"c", ago(300)),
        ("changed", 200, "e", "m", b"c", ago(4000)), ("down", 200, "e", "m", b"c", ago(4000)), ("silent", 200, "e", "m", b"c", ago(4000)),
        ("stale", 200, "e", "m", b"c", ago(30 * 86400)), ("gone", 404, None, None, b"", ago(5000)), ("unused", 200, "e", None, b"c", ago(1)),
    ]
    answers = [
        ("fresh", 0, 200, None, None, b"n"), ("same", 0, 304, None, None, None), ("changed", 0, 200, "e2", "m2", b"new"), ("down", 0, 503, None, None, None), ("down", 1, 200, "e3", None, b"later"),
        ("stale", 0, 304, None, None, None), ("stale", 1, 200, "e4", None, b"again"), ("gone", 0, 404, None, None, None), ("missing", 0, 404, None, None, None), ("missing", 1, 200, None, None, b"late"),
        ("third", 0, 500, None, None, None), ("third", 1, 502, None, None, None), ("third", 2, 200, "e5", None, b"ok"), ("never", 0, 500, None, None, None), ("never", 1, 500, None, None, None),
        ("never", 2, 500, None, None, None), ("never", 3, 200, None, None, b"too late"), ("big", 0, 200, None, None, b"y" * 11), ("fits", 0, 200, None, None, b"y" * 10),
    ]
    requests = spark.createDataFrame([(u, now) for u in ["fresh", "failed", "same", "changed", "down", "silent", "stale", "gone", "missing", "third", "never", "big", "fits", "nobody"]], "url string, at timestamp")
    cache = spark.createDataFrame(cached, CACHE)
    said = spark.createDataFrame(answers, "url string, attempt int, status int, etag string, modified string, body binary")
    out = loader.load(requests, cache, said, retries=1, most=10)
    got = {r.url: (r.outcome, r.status, bytes(r.body) if r.body is not None else None, r.etag, r.attempts, r.saved_at == now) for r in out.collect()}
    assert got == {
        "fresh": ("fresh", 200, b"c", "e", 0, False), "failed": ("failed before", 404, None, None, 0, False), "same": ("unchanged", 200, b"c", "e", 1, True),
        "changed": ("loaded", 200, b"new", "e2", 1, True), "down": ("kept", 200, b"c", "e", 1, False), "silent": ("kept", 200, b"c", "e", 0, False),
        "stale": ("loaded", 200, b"again", "e4", 2, True), "gone": ("kept", 404, b"", None, 1, False), "missing": ("not found", 404, None, None, 1, True),
        "third": ("loaded", 200, b"ok", "e5", 3, True), "never": ("failed", 500, None, None, 3, False), "big": ("too big", None, None, None, 1, False),
        "fits": ("loaded", 200, b"y" * 10, None, 1, True), "nobody": ("failed", 500, None, None, 0, False),
    }
    after = {r.url: (r.status, r.body, r.saved_at == now) for r in loader.cache_after(cache, out).collect()}
    assert after["missing"] == (404, b"", True) and after["same"] == (200, b"c", True) and after["down"] == (200, b"c", False) and after["unused"][1] == b"c"
    assert set(after) == {c[0] for c in cached} | {"missing", "third", "fits"}
    soft = {r.url: (r.outcome, r.body) for r in loader.load(requests, cache, said, retries=0, most=10, soft=True).collect()}
    assert soft["big"] == ("loaded", b"y" * 10) and soft["third"][0] == "failed"
    again = {r.url: r.outcome for r in loader.load(requests, loader.cache_after(cache, out), said, retries=1, most=10).collect()}
    assert again["missing"] == "failed before" and again["same"] == again["third"] == "fresh"


def test_validators_are_sent_with_old_pages_only(spark):
    cache = spark.createDataFrame([("a", 200, "e", "m", b"c", T0)], CACHE)
    ask = lambda s: loader.due(spark.createDataFrame([("a", T0 + dt.timedelta(seconds=s))], "url string, at timestamp"), cache).first()
    assert [(ask(s).state, ask(s).if_none_match, ask(s).if_modified_since) for s in (10, 300, 30 * 86400)] == [("fresh", None, None), ("check", "e", "m"), ("none", None, None)]
