import random

from inkstream.operators import mentions


def brute(text, names, fold=False):
    """Leftmost-longest by trying every name at every place."""
    fit = mentions.folded if fold else (lambda x: x)
    body, out, at = fit(text or ""), [], 0
    word = lambda c: c.isalnum() or c == "_"
    while at < len(body):
        here = [n for n in names if n and body.startswith(fit(n), at)]
        here = [n for n in here if not (at and word(body[at - 1]) and word(body[at])) and not (at + len(n) < len(body) and word(body[at + len(n)]) and word(body[at + len(n) - 1]))]
        best = max(here, key=lambda n: (len(n),), default=None)
        if best is None:
            at += 1
            continue
        out.append((at, len(best), fit(best)))
        at += len(best)
    return out


def _texts():
    random.seed(8)
    words = ["New", "York", "New York", "York Times", "the", "Times", "a_b", "b", "İzmir", "北京", "北", "O'Neil", "x-1", "TIMES", "-"]
    return words, [None, "", "New York Times New", "NewYork", "new york"] + ["".join(random.choice([*words, " ", " ", ", ", "s"]) for _ in range(30)) for _ in range(80)]


def test_leftmost_longest_names_in_one_block_and_many(spark):
    words, texts = _texts()
    names = ["New York", "York Times", "York", "New York Times Company", "Times", "a_b", "b", "İzmir", "北京", "北", "O'Neil", "x-1", "-"]
    gaz = spark.createDataFrame([(n, "place") for n in names] + [("York", "person"), (None, "x"), ("", "x")], "name string, kind string")
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    for fold in (False, True):
        for limit in (1 << 20, 12):
            found = mentions.find_mentions(docs, gaz, "id", "body", fold=fold, limit=limit)
            fit = mentions.folded if fold else (lambda x: x)
            got = {r.id: [(m.offset, m.length, fit(m.name)) for m in r.mentions] for r in found.collect()}
            assert got == {i: brute(t, names, fold) for i, t in enumerate(texts)}, (fold, limit)
    kinds = {m.name: m.kinds for r in mentions.find_mentions(docs, gaz, "id", "body").collect() for m in r.mentions}
    assert kinds["York"] == ["person", "place"] and kinds["b"] == ["place"]


def test_rows_for_the_store(spark):
    gaz = spark.createDataFrame([("Ann", "person"), ("Rome", "place"), ("Rome", "organisation")], "name string, kind string")
    found = mentions.find_mentions(spark.createDataFrame([(1, "Ann, Rome and Ann"), (2, "none")], "id int, body string"), gaz, "id", "body")
    assert sorted(tuple(r) for r in mentions.entities(found, "id").collect()) == [(1, "organisation", "Rome", 1), (1, "person", "Ann", 2), (1, "place", "Rome", 1)]
    assert mentions.find_mentions(spark.createDataFrame([(1, "Ann")], "id int, body string"), gaz.limit(0), "id", "body").first().mentions == []
