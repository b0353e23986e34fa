import datetime as dt

import pytest
from pyspark.sql import functions as F

from inkstream.operators import versioned
from inkstream.streaming import crawl

KIND = "k long, a string, b int"
DAY = lambda n: dt.datetime(2024, 1, n)
AT = lambda n: F.lit(DAY(n)).cast("timestamp")


@pytest.fixture
def put(spark, tmp_path):
    path = str(tmp_path / "t")

    def run(day, rows, **options):
        return versioned.merge(path, spark.createDataFrame(rows, KIND), ["k"], AT(day), **options)

    run.path = path
    return run


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_current_rows_and_history(spark, put):
    put(1, [(1, "x", 1), (2, "y", 2), (3, "z", 3), (None, "n", 0)])
    put(2, [(2, "yy", None), (3, "z", 3), (4, "w", None)])  # changed, the same, new
    gone = spark.createDataFrame([(1,), (99,), (4,)], "k long")
    put(3, [(4, "w2", 4), (2, "y", 2)], gone=gone)
    assert _rows(versioned.current(spark, put.path, KIND)) == sorted([(2, "y", 2, DAY(3)), (3, "z", 3, DAY(1)), (4, "w2", 4, DAY(3)), (None, "n", 0, DAY(1))], key=repr)
    assert _rows(versioned.history(spark, put.path, KIND).filter("valid_to is not null")) == sorted([(1, "x", 1, DAY(1), DAY(3)), (2, "y", 2, DAY(1), DAY(2)), (2, "yy", 2, DAY(2), DAY(3)), (4, "w", None, DAY(2), DAY(3))], key=repr)
    assert _rows(versioned.as_of(spark, put.path, KIND, AT(2))) == sorted([(1, "x", 1), (2, "yy", 2), (3, "z", 3), (4, "w", None), (None, "n", 0)], key=repr)
    assert [(r.commit, r.at) for r in versioned.log(spark, put.path).orderBy("commit").collect()] == [(0, DAY(1)), (1, DAY(2)), (2, DAY(3))]


def test_repeats_add_nothing(spark, put):
    rows = [(1, "x", 1), (1, "a", 2), (2, None, 2)]
    assert put(1, rows, commit="one") == 0
    assert put(2, rows, commit="one") is None
    assert put(2, rows, commit="two") == 1  # the same rows under another id
    assert _rows(versioned.history(spark, put.path, KIND)) == [(1, "a", 2, DAY(1), None), (2, None, 2, DAY(1), None)]
    assert put(3, []) is None


def test_untouched_buckets_are_not_read_or_written(spark, put):
    put(1, [(i, "x", i) for i in range(500)])
    put(2, [(7, "y", 7)])
    files = versioned.current(spark, put.path, KIND).inputFiles()
    assert len({f.split("/commit=")[1].split("/")[0] for f in files}) == 2
    assert sum("/commit=1/" in f for f in files) == 1
    assert versioned.current(spark, put.path, KIND).count() == 500
    (bucket,) = versioned.log(spark, put.path).filter("commit = 1").first().buckets
    assert all(f"bucket={bucket}/" in f for f in versioned._rows(spark, put.path, versioned._schema(spark.createDataFrame([], KIND), "valid_from"), versioned._buckets(spark, put.path, {bucket})).inputFiles())


def test_a_commit_without_log_entry_does_not_count(spark, put):
    put(1, [(1, "x", 1)])
    spark.createDataFrame([(1, "lost", 1, DAY(1), 0)], f"{KIND}, valid_from timestamp, bucket int").write.partitionBy("bucket").parquet(f"{put.path}/rows/commit=1")
    assert _rows(versioned.current(spark, put.path, KIND)) == [(1, "x", 1, DAY(1))]
    put(2, [(1, "y", 1)])
    assert _rows(versioned.current(spark, put.path, KIND)) == [(1, "y", 1, DAY(2))]


def test_a_new_checkpoint_over_a_table_keeps_its_rows(spark, tmp_path):
    """Batch numbers begin again with every checkpoint; the keys decide what is new."""
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    put = lambda *rows: spark.createDataFrame(rows, "k long, o int").coalesce(1).write.mode("append").parquet(source)
    run = lambda log: crawl.finish(crawl.read_stream(spark, source, "k long, o int"), str(tmp_path / log), crawl.upsert_into(path, ["k"], ["o"]))
    put((1, 2), (1, 1), (2, 2))
    run("one")
    put((3, 3), (1, 0))
    run("two")  # replays all
    run("two")
    assert _rows(crawl.upserted(spark, path, "k long, o int")) == [(1, 1), (2, 2), (3, 3)]
