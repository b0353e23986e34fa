import pyarrow as pa

from inkstream.operators import mentions
from inkstream.sources import arrow


def test_batches_are_taken_in_bounded_runs():
    texts = ["x" * 10, None, "", "y" * 500, "z" * 90, "w" * 20, "v"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(21)), pa.array(texts)], names=["k", "t"])
    for value, kind in ((texts, pa.string()), ([None if t is None else t.encode() for t in texts], pa.binary())):
        batch = pa.RecordBatch.from_arrays([pa.array(range(21)), pa.array(value, kind)], names=["k", "t"]).slice(1)
        parts = list(arrow.slices(batch, "t", 4, 100))
        assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(1, 21))
        assert all(p.num_rows <= 4 and (p.num_rows == 1 or sum(len(x or "") for x in p.column("t").to_pylist()) <= 100) for p in parts)
    assert not list(arrow.slices(batch.slice(0, 0), "t"))


def test_workers_get_small_batches(spark, monkeypatch):
    """Before, a worker got up to 64 MB at a time, here 400 texts of 100 KB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(0, 400, 1, 1).selectExpr("id", "if(id = 200, repeat('y', 9000000), repeat('x', 100000)) t")

    def weighed(whole, column):
        yield pa.RecordBatch.from_arrays([whole.column("id"), pa.array([str(whole.nbytes)] * whole.num_rows)], schema=whole.schema)

    monkeypatch.setattr(arrow, "slices", weighed)
    try:
        spark.conf.unset(name)
        got = [r.n for r in arrow.parse_column(texts, "t", int, "n", "long").collect()]
        assert len(got) == 400 and max(got) < (4 << 20) + 9_200_000 and sum(n > (4 << 20) + 200_000 for n in got) <= 42
        spark.conf.set(name, "1m")
        assert max(r.n for r in arrow.parse_column(texts.filter("id < 200"), "t", int, "n", "long").collect()) < 1_200_000
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)


def test_mentions_leave_a_task_in_bounded_runs(spark):
    """Before, what one Arrow batch of 10,000 texts mentions was made as a whole."""
    rows = spark.range(0, 5000, 1, 1).selectExpr("id key", "repeat('Ann met Bob. ', 40) text")
    found = mentions._pass(rows, [("Ann", ["p"]), ("Bob", ["p", "q"])], False, ["key"], True)
    sizes = found.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in bs), "n long").collect()
    assert sum(r.n for r in sizes) == 5000 and found.filter("size(mentions) <> 80 or mentions[79] <> named_struct('offset', 515, 'length', 3, 'name', 'Bob', 'kinds', array('p', 'q'))").isEmpty()
