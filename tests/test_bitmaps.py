import random

from pyspark.sql import functions as F

from inkstream.operators import bitmaps, search


def _docs(spark):
    random.seed(5)
    rows = [(i * 613 - 40_000, random.sample("abcd", random.randrange(4)), random.choice([None, [], ["x"], ["x", None, "x"]])) for i in range(400)]
    return spark.createDataFrame([*rows, rows[3], (None, ["a"], ["x"])], "id long, author array<string>, tags array<string>")


def _rows(df):
    return {(r.facet, r.value): r.n for r in df.collect()}


def test_counts_within_any_filter(spark, monkeypatch):
    docs = _docs(spark)
    kept = bitmaps.facet_bitmaps(docs, "id", ["author", "tags"])
    distinct = docs.filter("id is not null").dropDuplicates(["id"]).withColumn("tags", F.array_distinct(F.array_compact("tags")))
    cases = {
        "all": (bitmaps.result_bitmaps(docs, "id"), distinct),
        "some": (bitmaps.result_bitmaps(docs.filter("id % 3 = 0"), "id"), distinct.filter("id % 3 = 0")),
        "having": (bitmaps.having(kept, "author", ["a", "b"]), distinct.filter("array_contains(author, 'a') or array_contains(author, 'b')")),
        "both": (bitmaps.both(bitmaps.having(kept, "author", ["a"]), bitmaps.having(kept, "tags", ["x"])), distinct.filter("array_contains(author, 'a') and array_contains(tags, 'x')")),
        "either": (bitmaps.either(bitmaps.having(kept, "author", ["a"]), bitmaps.result_bitmaps(docs.filter("id > 100000"), "id")), distinct.filter("array_contains(author, 'a') or id > 100000")),
        "none": (bitmaps.having(kept, "author", ["z"]), distinct.limit(0)),
    }
    for most in (2_000, 0):
        monkeypatch.setattr(bitmaps, "BROADCAST_RANGES", most)
        for name, (result, rows) in cases.items():
            assert _rows(bitmaps.counts_within(kept, result)) == _rows(search.facet_counts(rows, ["author", "tags"])), name
            assert bitmaps.size(result).first().n == rows.count(), name


def test_counts_do_not_read_documents(spark, tmp_path):
    docs = _docs(spark)
    bitmaps.facet_bitmaps(docs, "id", ["author", "tags"]).write.parquet(str(tmp_path / "b"))
    kept = spark.read.parquet(str(tmp_path / "b"))
    found = bitmaps.counts_within(kept, bitmaps.having(kept, "author", ["a"]), ["tags"])
    assert set(_rows(found)) == {("tags", "x")}
    assert all("/b/" in f for f in found.inputFiles())
