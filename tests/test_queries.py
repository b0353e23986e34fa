"""Every registered query of the library against its SQL, over the smallest driver tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from inkstream.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sql, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert rows
        return
    found = sql.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_the_entry_is_importable_without_the_corpus_operators(spark, monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("inkstream.llm") else find(name, *a))
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE_SQL)
    assert entry.entry(spark).count() > 0
