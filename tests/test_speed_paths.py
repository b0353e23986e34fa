"""Shorter ways to the same results."""

import random

from pyspark.sql import functions as F

from inkstream.functions import variants
from inkstream.plans import base
from inkstream.sources import feeds, html_tree as ht


def _shape(n):
    return n.tag, n.attrs, [_shape(c) if isinstance(c, ht.Node) else c for c in n.children]


def test_plain_markup_gives_the_tokenizers_tree():
    random.seed(5)
    parts = ["<p>", "</p>", '<div class="a b">', "</div>", "<br/>", "<br>", '<a href="x" title="">', "</a>", "t &amp; x", "x &lt", "&notit;", "a\n", "<td>", "<tr>", "<table>", "</table>", "<li>", "<ul>", "<b/>", '<p a="1" a="2">', ">", '"', "é"]
    odd = ["</h1 >", "<!-- c -->", "<title>", "</title>", "<svg>", "&", "<", "\r\n", "\x00", "<script>", "<a b>", "<A>"]
    plain = 0
    for _ in range(5000):
        text = "".join(random.choices(parts if random.random() < 0.6 else parts + odd, k=random.randint(1, 9)))
        builder = ht._Builder()
        builder.feed(text)
        builder.close()
        assert _shape(ht.parse(text)) == _shape(builder.root), text
        plain += ht._plain(text) is not None
    assert plain > 1000


def test_tables_are_spread_by_rows(spark, tmp_path, monkeypatch):
    """Before, a scan of as many tasks as there are cores stayed as it was, however long its rows took."""
    monkeypatch.setattr(base, "ROWS_A_TASK", 100)
    spark.range(0, 5000, 1, 1).write.parquet(str(tmp_path / "t.parquet"))
    assert base.spread(spark.read.parquet(str(tmp_path / "t.parquet"))).rdd.getNumPartitions() == 50


def test_elements_of_a_feed_are_looked_at_once(monkeypatch):
    made, first = [], feeds._Element.__init__
    monkeypatch.setattr(feeds._Element, "__init__", lambda self, node: (made.append(1), first(self, node))[1])
    items = "".join(f"<item><title>t{i}</title><link>u{i}</link><guid>{i}</guid></item>" for i in range(20))
    found = feeds.parse_feed(f"<rss><channel><title>c</title>{items}</channel></rss>")
    assert [e["id"] for e in found["entries"]] == [str(i) for i in range(20)]
    assert len(made) <= 20 * 4 + 10  # before: each element for each name that was looked for


def test_a_path_of_a_variant_names_its_steps_once(spark):
    texts = ['{"a b":{"c":[{"D!":1,"d":""},2]},"x":0}', '{"a b":{"c":1},"a-b":{"c":{"D":2,"D!":3}}}', '{"a_b":[{"c":{"D":null}}]}', '{"a_b":{"c":{"D":""}}}', "[]", "7", "no", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", variants.parse(F.col("t")).alias("v"))
    found = rows.select("k", variants.text(variants.at(F.col("v"), "a_b.c.D")).alias("d"), F.size(variants.elements(variants.at(F.col("v"), "a_b.c"))).alias("n"))
    assert [(r.d, r.n) for r in found.orderBy("k").collect()] == [("1", 2), ("3", 1), (None, 1), (None, 1), (None, 0), (None, 0), (None, 0), (None, 0)]
    plan = rows.select(variants.at(F.col("v"), "a.b.c.d").alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("map_entries") == 4  # before: again for each mention, 4 ** 3 and more


def test_checked_pages_tell_each_part_alone(monkeypatch):
    page = '<p id="a">x<b>y</b><blink>z</blink></p><p id="a">'
    want = {"safe": ht.sanitize(page), "tokens": [f"{x['type']} {x['name']}" for x in ht.tokens(ht.parse(page))], "problems": ht.problems(page)}
    assert ht.checked(page) == want
    monkeypatch.setattr(ht, "sanitize", lambda t: 1 / 0)
    assert ht.checked(page) == want | {"safe": None}


def test_rounds_over_trees_broadcast_nothing(spark):
    """Before, Spark broadcast the side that is looked up, by the size of its file."""
    from inkstream.operators import graph

    state = spark.range(10).selectExpr("id", "id + 1 jump", "0L depth")
    plan = graph._doubled(state, {"jump": F.col("_jump")}, state)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
