import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from inkstream.streaming import crawl, refresh

T0 = dt.datetime(2024, 1, 1)


def _minutes(rows):
    return sorted((r.k, int((r.ts - T0).total_seconds() // 60), r.asked) for r in rows)


def expected(asked, every, until, keep=None, due=None):
    """Rows of one key by stepping through minutes."""
    out, last = [], due
    for t in range(until):
        if t in asked:
            last = t
            if due is None or t >= due:
                out.append((t, True))
                due = t + every
                continue
        if keep is not None and due == t:
            if due - last > keep:
                due = last = None
            else:
                out.append((t, False))
                due = t + every
    return out


class Requests:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0

    def put(self, *rows):
        """Rows (key, minute) as a file of their own."""
        df = self.spark.createDataFrame([(k, T0 + dt.timedelta(minutes=m)) for k, m in rows], "k string, ts timestamp")
        df.coalesce(1).write.mode("append").parquet(str(self.folder / "in"))

    def run(self, each=None, **options):
        stream = crawl.read_stream(self.spark, str(self.folder / "in"), "k string, ts timestamp", each)
        found = refresh.refreshes(stream, "k", "ts", 120, delay="10 minutes", **options)
        crawl.finish(found, str(self.folder / "log"), lambda b, n: b.write.mode("overwrite").parquet(str(self.folder / "out" / f"batch={n}")))
        return _minutes(self.spark.read.schema("k string, ts timestamp, asked boolean").parquet(str(self.folder / "out" / "batch=*")).collect())


def test_rows_do_not_depend_on_order_or_batches(spark, tmp_path):
    random.seed(2)
    asked = {k: random.sample(range(0, 900), 25) for k in "ab"}
    rows = [(k, m) for k, ms in asked.items() for m in ms] + [("a", asked["a"][0])]
    want = sorted((k, *x) for k, ms in asked.items() for x in expected(ms, 120, max(m for _, m in [*rows, ("z", 2000)]) - 10))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        falling = Requests(spark, tmp_path / "falling")
        falling.put(*sorted(rows, key=lambda r: -r[1]), ("z", 2000))
        got = falling.run()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [x for x in got if x[0] != "z"] == want


def test_a_query_that_starts_again_gives_the_same_rows(spark, tmp_path):
    asked = [5, 60, 125, 130, 240, 250, 400]
    r = Requests(spark, tmp_path)
    for part in (asked[:3], asked[3:5], asked[5:]):
        r.put(*[("a", m) for m in part])
        r.run()
    r.put(("z", 1000))
    assert [x for x in r.run() if x[0] == "a"] == [("a", *x) for x in expected(asked, 120, 900)]


def test_timers_fire_without_new_rows(spark, tmp_path):
    r = Requests(spark, tmp_path)
    r.put(("a", 0), ("a", 130), ("b", 50))
    r.put(("z", 1500))
    got = r.run(each=1, keep=400)
    assert [x[1:] for x in got if x[0] == "a"] == expected([0, 130], 120, 1490, 400)
    assert [x[1:] for x in got if x[0] == "b"] == expected([50], 120, 1490, 400)
    assert any(not x[2] for x in got)


def test_known_pages_and_state_as_a_table(spark, tmp_path):
    known = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=100)), ("c", None)], "k string, due timestamp")
    r = Requests(spark, tmp_path)
    r.put(("a", 20), ("a", 110), ("c", 5))
    r.put(("z", 1000))
    got = r.run(each=1, known=known)
    assert [x for x in got if x[0] != "z"] == [("a", 110, True), ("c", 5, True)]
    due = {x.k: int((x.due - T0).total_seconds() // 60) for x in refresh.due_times(spark, str(tmp_path / "log"), "k").collect()}
    assert due["a"] == 230 and due["c"] == 125


def test_requests_that_the_watermark_has_not_passed_are_taken_from_the_state(spark, tmp_path):
    asked = {"a": [5, 60, 125, 130, 240, 250, 395, 400, 400], "b": [391, 399], "c": [270, 389, 392], "d": [1]}
    r = Requests(spark, tmp_path)
    for part in (0, 1):
        r.put(*[(k, m) for k, ms in asked.items() for i, m in enumerate(ms) if i % 2 == part])
    got = r.run()
    rest = _minutes(refresh.remaining(spark, str(tmp_path / "log"), "k", "ts").collect())
    assert rest and sorted(got + rest) == [(k, *x) for k, ms in sorted(asked.items()) for x in expected(ms, 120, 500)]


def test_stream_due_reaches_the_end_of_the_input(spark, tmp_path):
    from inkstream.plans.registry import QUERIES

    rows = [(i, u, T0 + dt.timedelta(minutes=m)) for i, (u, m) in enumerate([(1, 0), (1, 130), (1, 260), (2, 255), (3, 10)])]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((r.user_id, int((r.ts - T0).total_seconds() // 60)) for r in QUERIES["stream_due"](spark, str(tmp_path)).collect())
    assert got == [(1, 0), (1, 130), (1, 260), (2, 255), (3, 10)]
