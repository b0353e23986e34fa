import numpy as np
import pytest
import xxhash

from inkstream.llm import simhash
from inkstream.llm.components import stars
from tests.llm.cases import by_id, documents, empty, plain, texts


def slow_fingerprint(text: str, k: int = 3) -> int:
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(points, bits):
    forest = simhash.Forest(len(points))
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None]) <= bits)
    forest.join(i, j)
    return forest.root


def crowd(n, seed):
    """Points, some of them a few bits from one another, some around one centre."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    near = base.copy()
    centre = np.full(n, base[0])
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        centre ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return np.unique(np.concatenate([base, near, centre]))


@pytest.mark.parametrize("bits", [0, 2, 3])
def test_trees_find_every_link(bits):
    points = crowd(700, bits)
    expected = roots(points, bits)
    assert (simhash.link(points, bits) == expected).all()
    tree = simhash.Tree(points[::3], 24, bits)
    shard, index = tree.route(points)
    forest = simhash.Forest(len(points))
    for s in range(tree.shards):
        own = np.unique(index[shard == s])
        forest.join(own, own[simhash.link(points[own], bits)])
    assert tree.shards > 1 and (forest.root == expected).all()


def test_query_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 4)
    monkeypatch.setattr(simhash, "SAMPLED_LEAF", 2)
    rows = by_id(simhash.near_duplicates(documents(spark)))
    prints = [slow_fingerprint(t or "") for t in texts()]
    root = roots(np.array(prints, np.uint64), 2)
    for row in rows:
        i = row.doc_id if row.doc_id is not None else 0
        assert row.fp & (2**64 - 1) == prints[i]
        assert row.component == root[i]
    assert simhash.near_duplicates(empty(spark)).collect() == []


def test_similar_documents_by_exact_similarity(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    found = []
    for _ in range(40):
        words = list(rng.choice(vocabulary, 120))
        found.append(" ".join(words))
        for changes in (1, 2, 4, 12):
            twin = list(words)
            for p in rng.integers(0, 120, changes):
                twin[p] = "new"
            found.append(" ".join(twin))
    found += ["", "", "one", "ONE", None]
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5)) for t in found]
    forest = simhash.Forest(len(found))
    for i in range(len(found)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (not sets[i] and not sets[j]) or both >= 0.8 * (len(sets[i] | sets[j])) > 0:
                forest.join(np.array([i]), np.array([j]))
    docs = plain(spark, list(enumerate(found)))
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == set(forest.root.tolist())


def test_one_of_a_group_stays_and_columns_too(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    words = lambda t: tuple((t or "").encode().lower().split())
    others = [t for i, t in enumerate(texts()) if i != 7]  # the seventh is the sixth with a word at either end
    assert sorted(words(r[1]) for r in kept.collect()) == sorted({words(t) for t in others})
    assert simhash.keep_one(empty(spark)).collect() == []


def test_stars_on_a_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.u: r.v for r in stars(path, "test").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


@pytest.mark.parametrize("similarity", [0.5, 0.8, 1.0])
def test_similar_pairs_by_counting(monkeypatch, similarity):
    monkeypatch.setattr(simhash, "COLUMNS", 7)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 30)).astype(np.uint64)) for _ in range(60)] + [np.zeros(0, np.uint64)] * 2
    expected = {(i, j) for i in range(62) for j in range(i) if (n := len(np.intersect1d(sets[i], sets[j]))) and n >= similarity * (len(sets[i]) + len(sets[j]) - n)}
    i, j = simhash.similar_pairs(sets, similarity)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == expected
    assert len(simhash.similar_pairs([], 0.8)[0]) == 0


def test_large_clusters_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 5)
    rng = np.random.default_rng(8)
    words = list(rng.choice([f"w{i}" for i in range(500)], 100))
    found = []
    for _ in range(40):
        twin = list(words)
        for p in rng.integers(0, 100, rng.integers(0, 4)):
            twin[p] = f"n{rng.integers(99)}"
        found.append(" ".join(twin))
    sets = [np.unique(np.array(simhash.shingle_hashes(t.encode(), 5), np.uint64)) for t in found]
    forest = simhash.Forest(40)
    forest.join(*simhash.similar_pairs(sets, 0.8))
    kept = {r.doc_id for r in simhash.keep_one(plain(spark, list(enumerate(found)))).collect()}
    assert kept == set(forest.root.tolist())


def test_equal_or_close_fingerprints_are_no_proof_of_similarity(spark):
    one, other = (" ".join(["same"] * 200 + [f"{c}{i}" for i in range(100)]) for c in "ab")
    a, b = simhash.fingerprints_of([one.encode(), other.encode()], 5)
    assert a == b
    docs = plain(spark, [(1, one), (2, other), (3, one + " more"), (4, one.upper())])
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {1, 2}


def test_large_shards_get_trees_of_their_own(spark, monkeypatch):
    """Links through two levels of trees are those of comparing all with all."""
    for name, value in (("SAMPLE", 64), ("SHARD", 16), ("SAMPLED_LEAF", 4), ("LEAVES", 8), ("BLOCK", 8)):
        monkeypatch.setattr(simhash, name, value)
    grown = []
    loads = simhash.pickle.loads
    monkeypatch.setattr(simhash.pickle, "loads", lambda b: grown.append(1) or loads(b))
    rng = np.random.default_rng(12)
    points = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    near = points[:500] ^ (np.uint64(1) << rng.integers(0, 63, 500).astype(np.uint64))
    points = np.unique(np.concatenate([points, near, near[:200] ^ (np.uint64(3) << rng.integers(0, 60, 200).astype(np.uint64))]))
    nodes = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    tree = simhash._deal(nodes, 2)
    assert tree.select("shard").distinct().count() > 8 * 4
    found = simhash.links(nodes, 2).collect()
    forest = simhash.Forest(len(points))
    at = {int(p): i for i, p in enumerate(points.view(np.int64))}
    forest.join(np.array([at[r.u] for r in found]), np.array([at[r.v] for r in found]))
    assert forest.root.tolist() == roots(points, 2).tolist()
