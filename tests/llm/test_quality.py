import zlib

import numpy as np
import pyarrow as pa
import pytest

from inkstream.llm import quality as q
from tests.llm.cases import by_id, documents, empty, plain, texts


def corpus(n=240):
    rng = np.random.default_rng(7)
    words = "the of and wind river stone light under over some long quiet house".split()
    good = [" ".join(rng.choice(words, rng.integers(20, 200))) + "." for _ in range(n)]
    return [(i, t if i % 3 else t.upper().replace(" ", "!! ")) for i, t in enumerate(good)]


def test_learns_from_the_open_folds_only(spark):
    rows = corpus()
    docs = plain(spark, rows)
    labels = [(i, int(i % 3 > 0)) for i, _ in rows]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a = q.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    b = q.learn(docs, spark.createDataFrame(flipped, "doc_id long, quality int"))
    assert (a.tables == b.tables).all() and (a.pair_tables == b.pair_tables).all()
    scores = {r.doc_id: r.score for r in q.score(docs, a).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(scores[i] >= 0.5) == (i % 3 > 0) for i in held]) > 0.97
    assert {r.doc_id for r in q.keep_good(docs, a).collect()} == {i for i, s in scores.items() if s >= 0.5}


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(2)
    x = np.zeros((800, len(q.FEATURES)))
    x[:, 3:5] = rng.random((800, 2))
    y = ((x[:, 3] > 0.5) ^ (x[:, 4] > 0.5)).astype(float)
    model = q.fit(x, y)
    assert model.pairs[0] == (3, 4)
    assert np.mean((model.score(x) >= 0.5) == y) > 0.9


def plain_score(model, x):
    """The model's sum by loops over rows, features, cuts and pairs."""
    out = []
    for row in x:
        bins = [sum(c <= v for c in cuts) for v, cuts in zip(row, model.cuts, strict=True)]
        total = model.start + sum(model.tables[k][b] for k, b in enumerate(bins))
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            at = []
            for k in (i, j):
                n = len(model.cuts[k])
                kept = sorted({round(t * (n - 1) / (m - 1)) if (m := min(n, q.PAIR_BINS - 1)) > 1 else 0 for t in range(min(n, q.PAIR_BINS - 1))})
                at.append(sum(c < bins[k] for c in kept))
            total += table[at[0]][at[1]]
        out.append(1 / (1 + np.exp(-max(-30, min(30, total)))))
    return out


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def test_scores_are_sums_of_table_values():
    rng = np.random.default_rng(4)
    x = np.round(rng.random((300, len(q.FEATURES))) ** 3, 1) * (rng.random(len(q.FEATURES)) < 0.7)
    y = ((x[:, 3] + x[:, 5] * x[:, 8] + 0.2 * rng.random(300)) > 0.4).astype(float)
    model = q.fit(x, y)
    assert np.allclose(model.score(x), plain_score(model, x), rtol=0, atol=1e-12)
    assert len(set(model.pairs)) == len(model.pairs) and all(len(model.cuts[k]) for p in model.pairs for k in p)


def test_pairs_add_to_the_main_effects():
    """Held-out rows, an interaction of features with few bins: without the pairs' tables the ranking is worse."""
    rng = np.random.default_rng(6)
    x = np.zeros((1600, len(q.FEATURES)))
    x[:, 2:7] = rng.integers(0, 4, (1600, 5))
    y = (x[:, 2] + 2.0 * ((x[:, 3] > 1) ^ (x[:, 4] > 1)) + rng.normal(0, 0.7, 1600) > 2.5).astype(float)
    model = q.fit(x[:800], y[:800])
    bare = q.Additive(model.start, model.cuts, model.tables, [], np.zeros((0, q.PAIR_BINS, q.PAIR_BINS)))
    assert model.pairs[0] == (3, 4)
    assert auc(model.score(x[800:]), y[800:]) > auc(bare.score(x[800:]), y[800:]) + 0.01


def test_scores_do_not_depend_on_the_batch():
    found = [t or "" for t in texts()]
    whole = q.features(pa.array(found))
    assert all((q.features(pa.array([t])) == whole[i : i + 1]).all() for i, t in enumerate(found))


@pytest.mark.parametrize("labels", [[], [(6, 1), (7, 1)], [(None, 1), (6, None)]])
def test_too_few_labels(spark, labels):
    docs = documents(spark)
    model = q.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = by_id(q.score(docs, model))
    assert len(rows) == len(texts()) + 3 and len({r.score for r in rows}) == 1
    assert q.keep_good(docs, model).columns == docs.columns


def test_odd_rows(spark):
    docs = plain(spark, corpus())
    model = q.learn(docs, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] * 2, "doc_id long, quality int"))
    rows = by_id(q.score(documents(spark), model))
    assert all(0 <= r.score <= 1 for r in rows)
    assert q.score(empty(spark), model).collect() == []
    assert q.learn(empty(spark), spark.createDataFrame([], "doc_id long, quality int")).score(np.zeros((1, len(q.FEATURES)))) == [0.5]
