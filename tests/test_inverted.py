import random
import re

import pytest
from pyspark.sql import functions as F

from inkstream.operators import inverted, search

WORDS = "river stone the of and token thing was light zebra".split()


def _docs(spark, rows):
    return spark.createDataFrame(rows, "id long, body string, extra string")


def _scores(df, key="id"):
    return {r[key]: round(r.score, 9) for r in df.collect()}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """An index after inserts, updates and deletes, and the documents as they then are."""
    path = str(tmp_path_factory.mktemp("index") / "i")
    random.seed(3)
    text = lambda: " ".join(random.choices(WORDS, weights=[3, 3, 30, 20, 20, 5, 5, 5, 2, 1], k=random.randrange(0, 60)))
    docs = {i * 977 % 20_011: text() for i in range(600)}
    docs[5], docs[6] = None, ""
    inverted.append(path, _docs(spark, [(i, t, None) for i, t in docs.items()]), "id", "body")
    changed = {i: text() for i in [*list(docs)[::7], 90_000, 90_001]}
    gone = [i for i in list(docs)[::11]]
    changed = {i: t for i, t in changed.items() if i not in gone}
    inverted.append(path, _docs(spark, [(i, t, None) for i, t in changed.items()]), "id", "body", _docs(spark, [(i, None, None) for i in [*gone, 123_456]]))
    docs = {i: t for i, t in (docs | changed).items() if i not in gone}
    back = {gone[0]: "zebra zebra light", 5: "zebra"}
    inverted.append(path, _docs(spark, [(i, t, None) for i, t in back.items()] + [(None, "zebra", None)]), "id", "body")
    return path, docs | back


@pytest.mark.parametrize("query", ["river", "the of zebra", "Zebra LIGHT token", "absent", "the the"])
def test_scores_are_those_of_a_scan(spark, corpus, query):
    path, docs = corpus
    expected = _scores(search.bm25(_docs(spark, [(i, t, None) for i, t in docs.items()]), query, "id", "body"))
    assert _scores(inverted.ranked(spark, path, query, "id")) == expected


def test_an_empty_query_matches_all(spark, corpus):
    path, docs = corpus
    assert _scores(inverted.ranked(spark, path, " ", "id")) == dict.fromkeys(docs, 0.0) == _scores(search.bm25(_docs(spark, [(i, t, None) for i, t in docs.items()]), "", "id", "body"))


@pytest.mark.parametrize("query", ["zebra", "the of zebra", "light stone", "absent"])
@pytest.mark.parametrize("k", [1, 10, 10_000])
def test_best_by_early_stop(spark, corpus, monkeypatch, query, k):
    path, docs = corpus
    monkeypatch.setattr(inverted, "FIRST_CELLS", 1)
    rows = search.bm25(_docs(spark, [(i, t, None) for i, t in docs.items()]), query, "id", "body").collect()
    expected = sorted(((-round(r.score, 9), r.id) for r in rows))[:k]
    assert [(-round(r.score, 9), r.id) for r in inverted.top(spark, path, query, k, "id").collect()] == expected


def test_only_the_words_buckets_are_read(spark, corpus):
    path, _ = corpus
    plan = inverted._blocks(spark, path, ["zebra"], inverted.batches(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)", plan) and "EqualTo(term,zebra)" in plan


def test_headers_are_read_without_postings(spark, corpus):
    path, _ = corpus
    plan = inverted._blocks(spark, path, ["zebra"], [0]).groupBy("cell").agg(F.max("most"))._jdf.queryExecution().executedPlan().toString()
    assert "docs" not in re.search(r"ReadSchema: \S+", plan).group()


def test_merged_batches_and_repeats(spark, tmp_path):
    path = str(tmp_path / "i")
    for _ in range(2):  # the same batch twice
        inverted.append(path, _docs(spark, [(1, "a b", None), (2, "a", None), (2, "a a", None)]), "id", "body", gen=0)
    inverted.append(path, _docs(spark, [(1, "b", None)]), "id", "body", _docs(spark, [(2, None, None)]), gen=1)
    inverted.append(path, _docs(spark, [(3, "a c", None)]), "id", "body")
    before = {q: _scores(inverted.ranked(spark, path, q, "id")) for q in "abc"}
    assert set(before["a"]) == {3} and set(before["b"]) == {1}
    gen = inverted.merge(path, spark)
    assert inverted.batches(spark, path) == [gen]
    assert {q: _scores(inverted.ranked(spark, path, q, "id")) for q in "abc"} == before
    inverted.append(path, _docs(spark, []), "id", "body", _docs(spark, [(3, None, None)]))
    assert _scores(inverted.ranked(spark, path, "a", "id")) == {} and set(_scores(inverted.ranked(spark, path, "b", "id"))) == {1}


def test_a_batch_without_totals_does_not_count(spark, tmp_path):
    path = str(tmp_path / "i")
    inverted.append(path, _docs(spark, [(1, "a", None)]), "id", "body")
    inverted._write_postings(inverted._postings(spark.sql("select 9L doc, 1 size, array('a') w")), path, 1)
    assert set(_scores(inverted.ranked(spark, path, "a", "id"))) == {1}


def test_words_are_not_shuffled_when_postings_are_made(spark):
    """Before, every pair of a word and a document was shuffled twice."""
    dealt = spark.range(100).selectExpr("id doc", "shiftright(id, 12) cell", "1 size", "array('a', 'b', 'a') w").repartition("cell")
    rows = inverted._postings(dealt)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted((r.term, r.n, r.most) for r in rows.collect()) == [("a", 100, 2), ("b", 100, 1)]
