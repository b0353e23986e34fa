"""Queries for adapters and extension points: records as feed items, facets, zones, titles, places, blocks, statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions import dates, template
from inkstream.functions import text as tx
from inkstream.operators import entities, feed_finder, lookup, pages, search
from inkstream.plans.base import NOW, query, read, spread
from inkstream.plans.parsed_queries import _markup
from inkstream.sources import microformats, tables


@query("""SELECT c_custkey, c_name AS title, '<p>On ' || c_mktsegment || '</p>' AS content, 'http://h.example/' || c_custkey AS link, 'Ann ' || c_custkey AS author, 'T ' || c_mktsegment || ',second' AS categories FROM customer""")
def feed_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A31, I100: entries of pages as items of a feed, with the author and categories."""
    c, k = spread(read(spark, sf_dir, "customer")), F.col("c_custkey")
    html = _markup('<div class="hentry"><h2 class="entry-title">', F.col("c_name"), '</h2><div class="entry-content"><p>On ', F.col("c_mktsegment"), '</p></div><span class="author vcard"><b class="fn">Ann ', k, '</b></span><span class="author vcard"><b class="fn">Bob</b></span><a rel="bookmark" href="http://h.example/', k, '">#</a><a rel="tag" href="/t/', F.col("c_mktsegment"), '">T ', F.col("c_mktsegment"), '</a><a rel="tag" href="/t/x">second</a></div>')
    found = microformats.records(c.select("c_custkey", html.alias("html")), "hatom", ["c_custkey"])
    out = microformats.feed_items(found, "hatom", ["c_custkey"])
    return out.select("c_custkey", "title", "content", "link", "author", F.array_join("categories", ",").alias("categories"))


@query("""SELECT s_suppkey, 'Talk ' || s_suppkey AS summary, '2024-05-0' || (s_suppkey % 9 + 1) || 'T10:00' AS dtstart, 'Hall ' || s_nationkey AS location FROM supplier""")
def header_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in cells of a table take day and place from their header cells."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    html = _markup('<table><tr><td></td><th id="day"><abbr class="dtstart" title="2024-05-0', k % 9 + 1, 'T10:00">d</abbr></th></tr><tr><th id="hall"><span class="location">Hall ', F.col("s_nationkey"), '</span><i class="summary">not this</i></th><td class="vevent" headers="day hall none"><b class="summary">Talk ', k, "</b></td></tr></table>")
    found = microformats.records(s.select("s_suppkey", html.alias("html")), "hcalendar", ["s_suppkey"])
    f = F.col("fields")
    return found.select("s_suppkey", f["summary"].alias("summary"), f["dtstart"].alias("dtstart"), f["location"].alias("location"))


@query(f"""WITH d AS (SELECT n_nationkey, n_name, n_regionkey FROM nation), a AS (SELECT s_nationkey AS k, list_sort(list(DISTINCT s_name)) AS author FROM supplier GROUP BY 1),
m AS (SELECT c_nationkey AS k, list_sort(list(DISTINCT c_mktsegment) FILTER (c_custkey % 3 = 0)) AS people, list_sort(list(DISTINCT c_mktsegment) FILTER (c_custkey % 3 = 1)) AS places FROM customer GROUP BY 1)
SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '<b>' || n_name ELSE 'http://h.example/' || n_nationkey END AS title, strftime(CASE WHEN n_nationkey % 2 = 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '{NOW}' END, '%Y-%m-%d') AS day, 'text' AS content, upper(n_name) AS shout,
  coalesce(array_to_string(author, ','), '') AS author, coalesce(array_to_string(people, ','), '') AS people, '' AS organisations, coalesce(array_to_string(places, ','), '') AS places, 't' || n_regionkey AS first_tag, 2 AS n_tags
FROM d LEFT JOIN a ON a.k = n_nationkey LEFT JOIN m ON m.k = n_nationkey""")
def faceted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5, I104, L10: search documents with five facets from their bridges, and a field of the caller's own."""
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    articles = n.select(
        k, F.concat(F.lit("http://h.example/"), k).alias("bookmark"), F.when(k % 3 == 0, F.concat(F.lit("<b>"), "n_name")).otherwise("").alias("entry_title"), F.lit("").alias("entry_content"), F.lit("<i>text</i>").alias("entry_summary"),
        F.lit(None).cast("timestamp").alias("updated"), F.when(k % 2 == 0, F.lit("2024-01-01").cast("timestamp")).alias("published"), F.concat(F.lit("t"), "n_regionkey", F.lit(",all")).alias("tags"), "n_name",
    )
    docs = search.documents(articles, F.lit(NOW).cast("timestamp"), {"shout": F.upper("n_name")})
    authors = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("name"))
    kind = F.element_at(F.array(F.lit("person"), F.lit("place"), F.lit("other")), (F.col("c_custkey") % 3 + 1).cast("int"))
    mentions = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), kind.alias("kind"), F.col("c_mktsegment").alias("name"))
    out = search.with_facets(docs, "n_nationkey", authors, mentions)
    listed = [F.array_join(f, ",").alias(f) for f in ("author", "people", "organisations", "places")]
    return out.select("n_nationkey", "title", F.date_format("date", "yyyy-MM-dd").alias("day"), "content", "shout", *listed, F.get("tags", F.lit(0)).alias("first_tag"), F.size("tags").alias("n_tags"))


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, last_day(make_date(year(o_orderdate), 3, 1)) AS a, last_day(make_date(year(o_orderdate), CASE WHEN year(o_orderdate) < 1996 THEN 9 ELSE 10 END, 1)) AS z FROM orders),
s AS (SELECT o_orderkey, d > a - CAST(dayofweek(a) AS INTEGER) AND d <= z - CAST(dayofweek(z) AS INTEGER) AS summer FROM d)
SELECT o_orderkey, CASE WHEN summer THEN '+02:00' ELSE '+01:00' END AS "offset", CASE WHEN summer THEN 120 ELSE 60 END AS minutes, summer FROM s""")
def zone_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Midnights in UTC; clocks change on the last Sundays of March and of September, since 1996 of October."""
    return read(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(k) for k, c in dates.zone_parts(F.col("o_orderdate").cast("timestamp"), "Europe/Paris").items()])


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN s_name || ': x' WHEN 2 THEN 'Who: ' || s_name ELSE 'May 5, 2009: ' || s_name END AS title FROM supplier""")
def feed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hosts put in front of titles."""
    hosts = F.array(*map(F.lit, ("http://twitter.com/f", "http://my.upcoming.yahoo.com/f", "http://other.example/f?twitter.com", "http://twitter.com:80/")))
    heads = F.array(F.lit("Who: "), F.lit("May 5, 2009: "), F.lit("Who: "), F.lit("May 5, 2009: "))
    at = (F.col("s_suppkey") % 4 + 1).cast("int")
    title = F.concat(F.element_at(heads, at), "s_name", F.when(F.col("s_suppkey") % 4 == 1, ": x").otherwise(""))
    return read(spark, sf_dir, "supplier").select("s_suppkey", pages.scrub_title(F.element_at(hosts, at), title).alias("title"))


@query("""SELECT s_suppkey, s_name AS plain, 'A & ' || s_name AS html, 'é<b>€' AS marked, 'é€' AS told, CAST(NULL AS VARCHAR) AS none, 'x &nope; &#x20AC; & <é' AS text FROM supplier""")
def entry_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of entries as texts, lists and records, and character references."""
    entry = F.concat(F.lit('{"plain":["'), "s_name", F.lit('","b"],"html":[{"type":"text/html","value":"A &amp; '), "s_name", F.lit('"}],"marked":{"type":"text/html","value":["&eacute;<b>&#8364;"]},"none":""}'))
    s = read(spark, sf_dir, "supplier").select("s_suppkey", entry.alias("e"))
    of = lambda k, t=False: pages.value_of(F.col("e"), k, t)
    return s.select("s_suppkey", of("plain").alias("plain"), of("html").alias("html"), of("marked").alias("marked"), of("marked", True).alias("told"), of("none").alias("none"), tx.unescape_html(F.lit("x &nope; &amp;#x20AC; & &lt;&#xE9;")).alias("text"))


@query("""SELECT page_id, page_id % 5 IN (0, 1, 2) AS language, page_id % 5 IN (0, 1) AS mime FROM pages""")
def valid_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I46."""
    at = (F.col("page_id") % 5 + 1).cast("int")
    codes = F.element_at(F.array(*map(F.lit, ("en", "zh-Hant-TW", "es-419", "e", "en_GB"))), at)
    types = F.element_at(F.array(*map(F.lit, ("text/html", 'text/x; a=b ; c="d e"', "text", "text/", "text/html; charset"))), at)
    return read(spark, sf_dir, "pages").select("page_id", lookup.valid_language(codes).alias("language"), lookup.valid_mime_type(types).alias("mime"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 5 <> 4 THEN CAST(c_nationkey AS DOUBLE) END AS latitude, CASE WHEN c_nationkey % 5 <> 4 THEN 2.0 END AS longitude, 2 AS n_fields FROM customer""")
def located_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G11, I101, I103, L11: addresses put together, their first hits, and entities without what belongs to one mention."""
    n, k = read(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 4"), F.col("n_nationkey")
    hit = lambda rank, lon: n.select(F.concat("n_name", F.lit(", World")).alias("address"), k.cast("double").alias("latitude"), F.lit(lon).alias("longitude"), F.lit(rank).alias("rank"))
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == k)
    line = entities.address_line(F.lit(" "), F.lower("n_name"), F.lit(None).cast("string"), F.lit("WORLD"))
    found = entities.geocoded(c.select("c_custkey", "n_name"), line, hit(2, 1.0).union(hit(1, 2.0)))
    fields = F.create_map(*[F.lit(x) for x in ("name", "a", "relevance", "0.5", "instances", "[]", "type", "City")])
    return found.select("c_custkey", "latitude", "longitude", F.size(entities.without_specifics(fields)).alias("n_fields"))


def _badge(resolve: template.Resolve, label: Column, value: Column) -> Column:
    return F.concat(F.lit("["), label, F.lit(": "), value.cast("string"), F.lit("]"))


@query("""SELECT c_custkey, 'Hi [seg "x": ' || c_mktsegment || ']' AS text, '{"title":"' || c_name || '","tags":["' || lower(c_mktsegment) || '",1,null],"of":{"key":"' || c_custkey || '"}}' AS object FROM customer""")
def rendered_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the caller's own with arguments; objects whose texts are templates."""
    template.register_block("badge", _badge)
    text = template.compile_template('Hi {% badge label:"seg \\"x\\"" value:c_mktsegment %}')
    told = template.render_object({"title": "{{ c_name }}", "tags": ["{{ c_mktsegment|lower }}", 1, None], "of": {"key": "{{ c_custkey }}"}})
    return read(spark, sf_dir, "customer").select("c_custkey", text.alias("text"), told.alias("object"))


@query("""SELECT s_suppkey, 'set' AS command, s_name AS said FROM supplier UNION ALL SELECT s_suppkey, 'say', 'hi ' || s_suppkey FROM supplier""")
def dispatched_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements, each given to the handler of its command."""
    s = read(spark, sf_dir, "supplier")
    code = F.concat(F.lit('# note\nset name:"'), "s_name", F.lit('" n:1;\nsay words:"""hi '), "s_suppkey", F.lit('""";\nskip all:[1, 2];'))
    found = tables.read_statements(s.select("s_suppkey", code.alias("code")), "code").select("s_suppkey", F.explode("statements").alias("x")).select("s_suppkey", "x.command", "x.arguments")
    told = lambda path: lambda rows: rows.select("s_suppkey", "command", F.get_json_object("arguments", path).alias("said"))
    return tables.dispatch(found, {"set": told("$.name"), "say": told("$.words")})


#: Pages of http://h.example/b/@/, and the stage and address by which their feeds are found.
_SITES = [
    ("<?xml version='1.0'?><rss><channel/></rss>", 1, "http://h.example/b/@/"),
    ('<html><link rel="alternate" type="application/rss+xml" href="../feed?a=1&amp;b=2#x"><link rel="alternate" type="text/html" href="/no"><a href="x.rss">x</a>', 2, "http://h.example/b/feed?a=1&b=2"),
    ('<a href="my-hint">h</a><a href="http://feeds.feedburner.com/z">z</a>', 3, "http://h.example/b/@/my-hint"),
    ('<a href="http://o.example/HINT">h</a><a href="x.rss">z</a>', 4, "http://o.example/HINT"),
    ('<a class=b href=\'http://feeds.feedburner.com/@\'>z</a><a href="x.rss">x</a>', 5, "http://feeds.feedburner.com/@"),
    ('<a href="./c/../x.RSS">x</a><a href="xml/">y</a><a href="http://o.example/a.rss">y</a>', 6, "http://h.example/b/@/x.RSS"),
    ('<a href="rss-feed">x</a><a href="myrss.html">x</a><a href="http://o.example/a.rss">y</a>', 7, "http://h.example/b/@/rss-feed"),
    ('<a href="//o.example/a.rdf">y</a><a href="http://o.example/rss">y</a>', 8, "http://o.example/a.rdf"),
    ('<opml><a href="x.rss">x</a></opml>', 0, ""),
]


@query("SELECT s_suppkey, CAST(stage AS INTEGER) AS stage, replace(href, '@', CAST(s_suppkey AS VARCHAR)) AS href FROM supplier JOIN (VALUES " + ", ".join(f"({i}, {n}, '{href}')" for i, (_, n, href) in enumerate(_SITES) if n) + f") v(i, stage, href) ON s_suppkey % {len(_SITES)} = i")
def found_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds by the first stage that finds any."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    html = F.replace(F.element_at(F.array(*[F.lit(t) for t, _, _ in _SITES]), (F.col("s_suppkey") % len(_SITES) + 1).cast("int")), F.lit("@"), k)
    sites = s.select("s_suppkey", F.concat(F.lit("http://h.example/b/"), k, F.lit("/")).alias("url"), html.alias("html"))
    return feed_finder.find(sites, "s_suppkey", hints=("hint$",))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 6 ELSE 8 END AS stage, CASE s_suppkey % 3 WHEN 0 THEN 'http://h.example/start/feed' WHEN 1 THEN 'http://h.example/p/' || s_suppkey || '/x.rss' ELSE 'http://o.example/a.rss' END AS href FROM supplier""")
def confirmed_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds that were saved and are feeds; those of the start page come first."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    links = '<a href="x.rss">x</a><a href="http://o.example/a.rss">y</a><link rel=alternate type="application/atom+xml" href="/gone">'
    sites = s.select("s_suppkey", F.concat(F.lit("http://h.example/p/"), k, F.lit("/")).alias("url"), F.concat(F.when(k % 3 == 0, '<link rel="start" href="/start/">').otherwise(""), F.lit(links)).alias("html"))
    one = F.when(k % 3 == 1, "<rss/>").otherwise("<html><rss>")
    more = spark.createDataFrame([("http://h.example/start/", '<link rel="alternate" type="text/xml" href="feed">'), ("http://h.example/start/feed", "<feed>"), ("http://o.example/a.rss", "<RDF>")], "url string, html string")
    saved = s.select(F.concat(F.lit("http://h.example/p/"), k, F.lit("/x.rss")).alias("url"), one.alias("html")).union(more)
    return feed_finder.find(sites, "s_suppkey", saved=saved)
