import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstream.operators import entities, graph, lookup, pages, runs, search, store
from inkstream.sources.arrow import parse_column
from inkstream.streaming import crawl


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_regroup_keeps_every_row_and_skips_nulls(spark):
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(["a", "a", None, "b", "a", "a"])], "u int, o int, k string")
    got = rows(runs.regroup(df, "k", ["u"], ["o"], "o"), "run")
    assert [(k, items) for _, _, k, items in got] == [("a", [0, 1]), ("b", [3]), ("a", [4, 5])]
    assert runs.regroup(df.limit(0), "k", ["u"], ["o"], "o").collect() == []


def test_upsert_twice_is_upsert_once(spark):
    stored = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, n string, s string")
    found = spark.createDataFrame([(2, None, "z"), (3, "c", None)], "id int, n string, s string")
    once = store.upsert(found, stored, ["id"])
    assert rows(once, "id") == rows(store.upsert(found, once, ["id"]), "id") == [(1, "a", "x"), (2, "b", "z"), (3, "c", None)]


def test_every_schema_can_be_read(spark):
    assert all(T._parse_datatype_string(s) for s in store.SCHEMAS.values())


def test_due_is_strict(spark):
    df = spark.sql("select 1 id, timestamp'2024-01-01' refresh_at union all select 2, null union all select 3, timestamp'2023-12-31'")
    assert [r.id for r in store.due_pages(df, F.lit("2024-01-01").cast("timestamp")).collect()] == [3]


def test_facets_pages_and_json(spark):
    docs = spark.createDataFrame([(1, ["a", "b"], ["x"]), (2, ["a"], []), (3, None, ["x"])], "id int, author array<string>, tags array<string>")
    counts = search.facet_counts(docs, ["author", "tags"])
    assert rows(counts, "facet", "value") == [("author", "a", 2), ("author", "b", 1), ("tags", "x", 2)]
    assert [r.id for r in search.page(docs, [F.col("id")], 2, 2).collect()] == [3]
    assert search.page_links(41, 2, 20) == {"pages": 3, "previous": 1, "next": 3}
    out = search.result_json(docs.select("id"), search.facet_top(counts), 3, 1, 20).first()
    assert '"id":1' in out.articles and '"facet":"author"' in out.facets


def test_entities(spark):
    df = spark.sql("select 'abcdef' t, array(named_struct('offset', 1, 'length', 2, 'uri', 'u'), named_struct('offset', 4, 'length', 1, 'uri', 'v')) m")
    assert df.select(entities.link_mentions(F.col("t"), F.col("m"))).first()[0] == 'a<a href="u">bc</a>d<a href="v">e</a>f'
    assert [r[0] for r in spark.createDataFrame([("x" * 99,), ("x" * 100,)], "t string").select(entities.analysable(F.col("t"))).collect()] == [False, True]
    objs = spark.createDataFrame([("k1", "A", "k2"), ("k2", "B", None)], "k string, name string, ref string")
    assert rows(entities.inline_references(objs, "k", "ref").select("k", "ref"), "k") == [("k1", "B"), ("k2", None)]
    ranked = spark.sql("select array(named_struct('n', 'a', 'relevance', 0.1), named_struct('n', 'b', 'relevance', 0.9)) e").select(entities.by_relevance(F.col("e"))["n"]).first()[0]
    assert ranked == ["b", "a"]


def test_lookups(spark):
    df = spark.createDataFrame([("44123",), ("1416",), ("99",), (None,)], "d string")
    dim = spark.createDataFrame([("4", "four"), ("44", "uk"), ("1", "us")], "p string, c string")
    short = {r.d: r.c for r in lookup.shortest_prefix(df, dim, "d", "p", "c").collect()}
    far = {r.d: r.c for r in lookup.longest_prefix(df, dim, "d", "p", "c").collect()}
    assert {k: (short[k], far[k]) for k in short} == {"44123": ("four", "uk"), "1416": ("us", "us"), "99": (None, None), None: (None, None)}


def test_closures(spark):
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 5)], "src int, dst int")
    assert rows(graph.follow_next(spark.sql("select 0 page"), links), "page") == [(0, 0), (1, 1), (2, 2), (5, 3)]


def test_long_chains_are_followed_to_the_end_in_few_rounds(spark, monkeypatch):
    written = []
    settled = graph.settled
    monkeypatch.setattr(graph, "settled", lambda df, name: written.append(name) or settled(df, name))
    links = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = graph.follow_next(spark.sql("select 0L page"), links.union(spark.sql("select 10000L, 7L")))
    assert found.agg(F.count("*"), F.max("hops"), F.sum("hops")).first()[:] == (10_001, 10_000, 50_005_000)
    assert len(written) < 45  # two tables for each of 14 rounds, and a few more
    written.clear()
    ends = graph.tree_ends(spark.range(10_000).select("id", F.nullif(F.col("id") - 1, F.lit(-1)).alias("parent")))
    assert ends.filter("kind = 'root' and top = 0 and depth = id").count() == 10_000
    assert len(written) < 20


def test_links_that_branch_meet_and_cycle(spark):
    import collections
    import random

    random.seed(4)
    links = [(random.randrange(60), random.randrange(60)) for _ in range(75)] + [(i, i + 1) for i in range(60, 90)] + [(3, 60), (90, 3), (None, 1), (2, None)]
    start = [0, 5, 5, None, 200]
    hops, todo = {0: 0, 5: 0, 200: 0}, collections.deque([0, 5, 200])
    while todo:
        page = todo.popleft()
        for a, b in links:
            if a == page and b is not None and b not in hops:
                hops[b] = hops[page] + 1
                todo.append(b)
    found = graph.follow_next(spark.createDataFrame([(p,) for p in start], "page int"), spark.createDataFrame(links, "src int, dst int"))
    assert dict(rows(found, "page")) == hops


def test_every_node_of_a_tree_has_an_end(spark):
    """Roots, deep paths, parents that are not there, cycles of one and more nodes with what hangs on them, repeats."""
    nodes = [(i, i - 1 if i else None, str(i)) for i in range(300)]
    nodes += [(1000, 999, "o"), (1001, 1000, "p"), (2000, 2001, "a"), (2001, 2002, "b"), (2002, 2000, "c"), (1990, 2001, "tail"), (1991, 1990, "tail of tail"), (3000, 3000, "self"), (3001, 3000, None)]
    nodes += [(4000, None, None), (4001, 4000, "x"), (4001, 4000, "x"), (5, 7, "again"), (None, 5, "no id")]
    got = {r.id: (r.kind, r.depth, r.top, r.path) for r in graph.flatten_tree(spark.createDataFrame(nodes, "id long, parent long, title string")).collect()}
    want = {i: ("root", i, 0, "/".join(map(str, range(i + 1)))) for i in range(300)}
    want |= {1000: ("orphan", 0, 999, "o"), 1001: ("orphan", 1, 999, "o/p")}
    want |= {i: ("cycle", None, 2000, None) for i in (2000, 2001, 2002, 1990, 1991)} | {i: ("cycle", None, 3000, None) for i in (3000, 3001)}
    assert got == want | {4000: ("root", 0, 4000, ""), 4001: ("root", 1, 4000, "x")}
    assert graph.flatten_tree(spark.createDataFrame([], "id long, parent long, title string")).collect() == []


def test_prefixes_of_any_length(spark):
    paths = ["http://example.com/", "http://example.com/a/long/path/", "ftp://"]
    dim = spark.createDataFrame([(p, p.upper()) for p in paths], "p string, c string")
    values = [paths[1] + "x", paths[0] + "a", paths[0], "ftp://h/", "http://", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v: r.c for r in lookup.longest_prefix(df, dim, "v", "p", "c").collect()}
    assert [got[v] for v in values] == [paths[1].upper(), paths[0].upper(), paths[0].upper(), "FTP://", None, None]
    assert [r.c for r in lookup.longest_prefix(df, dim.limit(0), "v", "p", "c").collect()] == [None] * len(values)


def test_prefixes_that_repeat_nest_and_cross_bins(spark):
    import random

    random.seed(9)
    word = lambda n: "".join(random.choice("ab/é") for _ in range(random.randrange(n)))
    dim = [(word(7), random.choice([None, 1, 2, 3])) for _ in range(300)] + [("ab", 9), ("ab", 4), (None, 1)]
    values = [word(12) for _ in range(500)] + ["ab" * 40] * 50 + [None, ""]
    known = {}
    for p, o in dim:
        if p is not None:
            known[p] = min((x for x in (known.get(p), o) if x is not None), default=None)
    for most in (None, 3):
        of = {v: [p for p in sorted(known, key=len) if v is not None and v.startswith(p) and (most is None or len(p) <= most)] for v in values}
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        got = lookup.prefix_matches(df, spark.createDataFrame(dim, "p string, o int"), "v", "p", "o", most).collect()
        assert len(got) == len(values)
        assert all((r.shortest, r.longest) == ((known[of[r.v][0]], known[of[r.v][-1]]) if of[r.v] else (None, None)) for r in got)


def test_images_and_feeds(spark):
    html = '<img src="a.png" width="15"><img src="b.png" width=16 height="20"><img src="b.png"><link rel="alternate" type="application/rss+xml" href="/f"><base href="http://b/">'
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert rows(pages.images(df), "pos") == [(1, 0, "b.png")] and rows(pages.feeds(df), "href") == [(1, "/f")]
    assert df.select(pages.base_href(F.col("html"))).first()[0] == "http://b/"


def test_parse_column_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "ab")], "i int, t string")
    assert rows(parse_column(df, "t", len, "n", "int"), "i") == [(1, None, None), (2, "ab", 2)]


def test_stream_once_each(spark, tmp_path):
    df = spark.sql("select * from values (timestamp'2024-01-01 00:00:00', 'a'), (timestamp'2024-01-01 01:00:00', 'a'), (timestamp'2024-01-01 02:00:00', 'b') as t(ts, url)")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = crawl.read_stream(spark, str(tmp_path / "in"), "ts timestamp, url string")
    crawl.finish(crawl.once_each(stream, "url", "ts"), str(tmp_path / "log"), lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={n}")))
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_repeated_batches_change_nothing(spark, tmp_path):
    write = crawl.upsert_into(str(tmp_path / "t"), ["k"], ["o"])
    batch = spark.createDataFrame([(1, 2), (1, 1), (2, 5)], "k int, o int")
    for n in (0, 0, 1, 1):
        write(batch, n)
    assert rows(crawl.upserted(spark, str(tmp_path / "t"), "k int, o int"), "k") == [(1, 1), (2, 5)]


def test_robots(spark):
    from inkstream.operators import robots

    text = "User-agent: a\nUser-agent: *\nDisallow: /x\nAllow: /x/y\nDisallow:\nUser-agent: bot\nDisallow: /"
    assert robots.rules_of(text, "mybot/1") == [{"allow": False, "path": "/"}]
    rules = robots.read_rules(spark.createDataFrame([("h.com", text)], "host string, text string"), "text")
    links = ["http://h.com/x", "http://h.com/x/y?q", "http://h.com/", "http://o.com/x"]
    got = {r.url for r in robots.may_fetch(spark.createDataFrame([(u,) for u in links], "url string"), rules).collect()}
    assert got == set(links[1:])


def test_contacts(spark):
    from inkstream.operators import contacts

    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(contacts.street(F.lit(s))) for s in ("1 Main St.", "2 St James Rd W", "Broadway", "5 N")] == ["1 Main Street", "2 St James Road West", "Broadway", "5 N"]
    assert [one(contacts.postal_region(F.lit(p))) for p in ("v6b 1a1", "90210", "D1A 1A1")] == ["British Columbia", None, None]
    assert one(contacts.region_country(contacts.region_name(F.lit("qc")))) == "CA"
    names = lookup.split_name(F.lit("Lee, Ann Mary"))
    assert [one(names[k]) for k in ("given_name", "additional_name", "family_name", "honorific_prefix")] == ["Ann", "Mary", "Lee", None]
    assert one(lookup.scrub_name(F.lit('bob (work) McGee'), F.lit("ACME"), F.lit("e"))) == "Bob McGee" and one(lookup.scrub_name(F.lit(""), F.lit(""), F.lit("e.f@g"))) == "E F"


def test_every_next_link_is_followed(spark):
    from inkstream.operators import crawl_step

    html = '<a rel="next" data-href="/no" href="?a=1&amp;p=2">x</a><a href=/p3 rel="x next">y</a><a rel="next-post" href="/no">z</a><link rel="next" href="/no"><!-- <a rel=next href=/no> --><a rel=next href=/p3>again</a><a rel="next">none</a>'
    df = spark.createDataFrame([("http://h.example/d/x", html), ("http://h.example/", "<p>nothing"), ("http://h.example/n", None)], "url string, html string")
    got = {(r.url, r.next) for r in crawl_step.next_pages(df).collect()}
    assert got == {("http://h.example/d/x", "http://h.example/d/x?a=1&p=2"), ("http://h.example/d/x", "http://h.example/p3")}


def test_attributes_as_browsers_read_them(spark):
    tag = """<img alt='a > b src=no' data-src=no SRC = x.png width="20px"height='30' src=second hidden title=a"b>"""
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(pages.tags(F.lit("<p>" + tag + "<image src=no><IMG/><!-- <img> "), "img")) == [tag, "<IMG/>"]
    assert [one(pages.attribute(F.lit(tag), n)) for n in ("src", "width", "height", "alt", "hidden", "none")] == ["x.png", "20px", "30", "a > b src=no", "", ""]
    df = spark.createDataFrame([(1, "<img src='a.png' width=15><img src=b.png height=16 width='200'>")], "page_id int, html string")
    assert rows(pages.images(df), "pos") == [(1, 0, "b.png")]
