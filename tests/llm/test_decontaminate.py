import random

from inkstream.llm import decontaminate as d
from tests.llm.cases import by_id, documents, empty, plain, texts


def brute(text, items):
    w = d.words_of((text or "").encode())
    hit, found = [0] * len(w), set()
    for name, t in items:
        q = d.words_of((t or "").encode())
        n = min(len(q), 10)
        for k in range(len(q) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == q[k : k + n]:
                    found.add(name)
                    hit[p : p + n] = [1] * n
    return len(w), sum(hit), sorted(found)


def test_matches_brute_force():
    random.seed(1)
    for _ in range(200):
        v = "abcd"[: random.randint(1, 4)]
        make = lambda m, v=v: " ".join(random.choice(v) for _ in range(random.randint(0, m)))
        items = [(str(i), make(random.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15]))) for i in range(random.randint(0, 6))]
        docs = [make(40) for _ in range(6)]
        for text, x in zip(docs, d.longest_matches([t.encode() for t in docs], d.TestSet(items)), strict=True):
            assert (x.words, sum(b - a for a, b in x.runs), sorted(items[i][0] for i in x.items)) == brute(text, items)
            assert [m[:2] for m in x.matches] == maximal(text, items)
            q = [d.words_of(t.encode()) for _, t in items]
            for place, n, i, at, times in x.matches:
                assert q[i][at : at + n] == d.words_of(text.encode())[place : place + n]
                places = [(j, k) for j, t in enumerate(q) for k in range(len(t) - n + 1) if t[k : k + n] == q[i][at : at + n] and (n >= 10 or len(t) == n)]
                assert times == len(places) and (i, at) in places
            assert all(a < b < c for (a, b), (c, _) in zip(x.runs, x.runs[1:], strict=False))


def maximal(text, items):
    """(place, words): how far a text goes on like some item from where a window opens, unless that is part of what came
    from the place before."""
    w, out = text.split(), []
    for p in range(len(w)):
        best = 0
        for _, t in items:
            q = t.split()
            for a in range(len(q)):
                n = 0
                while a + n < len(q) and p + n < len(w) and q[a + n] == w[p + n]:
                    n += 1
                if n >= min(len(q), 10) and (len(q) >= 10 or a == 0):
                    best = max(best, n)
        out.append(best)
    return [(p, n) for p, n in enumerate(out) if n and not (p and n < out[p - 1])]


def test_matches_as_long_as_they_go():
    item = " ".join(f"w{i}" for i in range(40))
    text = "x y " + " ".join(f"w{i}" for i in range(5, 38)) + " z " + " ".join(f"w{i}" for i in range(12))
    (x,) = d.longest_matches([text.encode()], d.TestSet([("i", item)]))
    assert x.matches == [(2, 33, 0, 5, 1), (36, 12, 0, 0, 1)]


def test_repeated_words_make_no_pairs():
    """One word 40,000 times against 2,000 times: work and memory follow the words, not the pairs of places."""
    import resource
    import time

    tests = d.TestSet([("a", "x " * 2000), ("b", "x " * 1500 + "y")])
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    (x,) = d.longest_matches([b"x " * 40_000], tests)
    assert x.runs == [(0, 40_000)] and x.items == {0, 1} and max(m[1] for m in x.matches) == 2000
    assert len(x.matches) == 38_001  # from each place until the text is nearer its end than the longest item is long
    assert time.perf_counter() - began < 4 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def test_tests_take_bounded_memory():
    """A block of tests as large as may be, of distinct words and of repeated ones, in a process of its own."""
    import subprocess
    import sys

    code = """
import random, resource
from inkstream.llm import decontaminate as d
random.seed(1)
words = [f"{random.randrange(10**6):x}" for _ in range(200_000)]
items = [(str(i), " ".join(random.choices(words, k=400))) for i in range(d.BLOCK_BYTES // 2300)] + [("r", "again " * 50_000)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
tests = d.TestSet(items)
d.longest_matches([items[0][1].encode(), b"again " * 1000], tests)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    kb = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert kb < 250_000


def _benchmark(spark, items):
    return spark.createDataFrame([(int(n), t, "x") for n, t in items], "item_id long, text string, extra string")


ITEMS = [("10", "same passage of words that stands in several documents and is longer"), ("9", "word"), ("2", "Before the"), ("3", ""), ("4", None), ("5", "ünïcode WORDS"), ("6", "Ünïcode WORDS and")]


def test_query_rows(spark):
    said = []
    for limit in (1 << 20, 1):
        found = d.find_contamination(documents(spark), _benchmark(spark, ITEMS), limit=limit)
        rows = by_id(found)
        said.append([(r.doc_id, r.n_words, r.runs, r["items"], sorted(r.matches)) for r in rows])
        assert len(rows) == len(texts()) + 3
        for row in rows:
            n, hit, names = brute(texts()[row.doc_id] if row.doc_id is not None else None, ITEMS)
            assert (row.n_words, sum(r.b - r.a for r in row.runs), row["items"]) == (n, hit, names)
            assert all(r.a < r.b for r in row.runs) and {m.item for m in row.matches} == set(names)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(said[0], key=key) == sorted(said[1], key=key)


def test_removal_keeps_columns_and_clean_rows(spark):
    docs = documents(spark)
    kept = d.remove_contaminated(docs, _benchmark(spark, ITEMS))
    assert kept.columns == docs.columns
    blocks = d.remove_contaminated(docs, _benchmark(spark, ITEMS), limit=1)
    assert blocks.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, blocks.collect()))
    upper = plain(spark, [(1, "word"), (2, "clean")]).toDF("DOC_ID", "TEXT", "a", "b", "c")
    assert [r[0] for r in d.remove_contaminated(upper, _benchmark(spark, ITEMS)).collect()] == [2]
    dirty = {i for i, t in enumerate(texts()) if brute(t, ITEMS)[1]}
    ids = {r[0] for r in kept.collect()}
    assert ids == set(range(len(texts()))) - dirty | {None} and dirty


def test_empty_sides(spark):
    assert d.find_contamination(empty(spark), _benchmark(spark, ITEMS)).collect() == []
    clean = d.digest(d.find_contamination(plain(spark, [(1, "a b"), (2, None)]), _benchmark(spark, []))).collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in sorted(clean)] == [(2, 0, 0, False), (0, 0, 0, False)]


def test_a_text_without_words_between_hits_is_clean(spark):
    texts = ["one same", "", "same two"]
    assert [x.runs for x in d.longest_matches([t.encode() for t in texts], d.TestSet([("1", "same")]))] == [[(1, 2)], [], [(0, 1)]]
    docs = plain(spark, list(enumerate(texts))).coalesce(1)
    assert [r.doc_id for r in d.remove_contaminated(docs, _benchmark(spark, [("1", "same")])).collect()] == [1]
