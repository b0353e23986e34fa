"""Queries over planted markup: the crawl step, further microformats, entities in texts, forms, tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkstream.functions import coerce, records, urls
from inkstream.operators import crawl_step, entities, pages, runs, search, store
from inkstream.plans.base import NOW, query, read, spread
from inkstream.plans.parsed_queries import _markup
from inkstream.sources import html_tree, microformats, tables
from inkstream.sources.arrow import parse_column


def _news_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of two entries for each customer: a story of its own, and one that other pages have as well."""
    c, k, seg = read(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("c_mktsegment")
    url = F.concat(F.lit("http://site"), k % 5, F.lit(".example/"), F.lpad(k.cast("string"), 8, "0"))
    html = _markup(
        '<html><body><address class="author vcard"><span class="fn">Staff ', seg, '</span></address><div class="hfeed"><div class="hentry"><h2 class="entry-title">Story ', k, '</h2><div class="entry-content"><p>On ', seg,
        '</p></div><abbr class="updated" title="2024-01-0', k % 9 + 1, 'T10:00:00+01:00">x</abbr><a rel="bookmark" href="/s/', k, '">#</a><a rel="tag" href="/t/', seg, '">t</a><a rel="tag" href="/t/', k % 3, '/">t</a><span class="dateline">Town ', k % 7,
        '</span></div><div class="hentry"><h2 class="entry-title">Shared ', k % 10, " seen by ", k, '</h2><a rel="bookmark" href="http://site.example/shared/', k % 10, '">#</a></div></div><a class="x" rel="next" href="', F.when(k % 2 == 0, "/").otherwise("?p="), k + 1, '">more</a></body></html>',
    )
    return spread(c.select(url.alias("url"), html.alias("html"), k.alias("k")))


@query(f"""WITH p AS (SELECT c_custkey AS k, c_mktsegment AS seg, 'http://site' || (c_custkey % 5) || '.example/' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS url FROM customer),
own AS (SELECT 'http://site' || (k % 5) || '.example/s/' || k AS bookmark, 'Story ' || k AS title, '<p>On ' || seg || '</p>' AS content, TIMESTAMP '2024-01-01 09:00:00' + INTERVAL (CAST(k % 9 AS INTEGER)) DAY AS updated, TIMESTAMP '{NOW}' AS published,
  lower(seg) || ',' || (k % 3) AS tags, 'Staff ' || seg AS author, 'Town ' || (k % 7) AS dateline FROM p),
shared AS (SELECT 'http://site.example/shared/' || (k % 10) AS bookmark, 'Shared ' || (k % 10) || ' seen by ' || k AS title, NULL AS content, TIMESTAMP '{NOW}' AS updated, TIMESTAMP '{NOW}' AS published, '' AS tags, 'Staff ' || seg AS author, NULL AS dateline
  FROM p WHERE k % 10 <> 3 QUALIFY row_number() OVER (PARTITION BY k % 10 ORDER BY url) = 1)
SELECT * FROM own UNION ALL SELECT * FROM shared UNION ALL SELECT 'http://site.example/shared/3', 'known', 'kept', TIMESTAMP '2023-01-01 00:00:00', NULL, 'a', NULL, NULL""")
def crawled_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to articles, the crawl's write path in one plan."""
    stored = spark.sql("SELECT 'http://site.example/shared/3' AS bookmark, 'known' AS title, 'kept' AS content, TIMESTAMP '2023-01-01 00:00:00' AS updated, CAST(NULL AS TIMESTAMP) AS published, 'a' AS tags, CAST(NULL AS STRING) AS author, CAST(NULL AS STRING) AS dateline")
    return crawl_step.crawl(_news_pages(spark, sf_dir), stored, F.lit(NOW).cast("timestamp"))


@query("""WITH p AS (SELECT c_custkey AS k, 'http://site' || (c_custkey % 5) || '.example/' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS url FROM customer)
SELECT url, CASE WHEN k % 2 = 0 THEN 'http://site' || (k % 5) || '.example/' || (k + 1) ELSE url || '?p=' || (k + 1) END AS next FROM p""")
def next_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links that a crawl of whole sites follows."""
    return crawl_step.next_pages(_news_pages(spark, sf_dir))


@query("""SELECT s_suppkey, 'Desk ' || s_nationkey AS author, 'City ' || s_nationkey AS dateline, 'http://p.example/' || s_suppkey AS principles, s_name AS source FROM supplier""")
def news_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a news entry has besides, and the author that stands around the entries."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    html = _markup('<address class="author vcard"><b class="fn">Desk ', F.col("s_nationkey"), '</b></address><div class="hentry"><h3 class="entry-title">t</h3><span class="dateline">City ', F.col("s_nationkey"), '</span><a rel="principles" href="http://p.example/', k, '">p</a><span class="source-org vcard"><a class="url fn org" href="http://o.example/">', F.col("s_name"), "</a></span></div>")
    found = microformats.microformats(s.select("s_suppkey", html.alias("html")), "html", ("hatom", "hnews"))
    one = lambda name: F.get(F.filter("records", lambda r: r["format"] == name), F.lit(0))
    child = lambda kind, name: F.get(F.filter(one(kind)["children"], lambda c: c["name"] == name), F.lit(0))["fields"]["fn"]
    return found.select("s_suppkey", child("hatom", "author").alias("author"), one("hnews")["fields"]["dateline"].alias("dateline"), one("hnews")["fields"]["principles"].alias("principles"), child("hnews", "source-org").alias("source"))


@query("""SELECT c_custkey, c_mktsegment AS summary, c_name AS contact FROM customer""")
def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card that names its holder by reference to an element elsewhere on the page."""
    c = spread(read(spark, sf_dir, "customer"))
    html = _markup('<h1 id="holder" class="fn">', F.col("c_name"), '</h1><div class="hresume"><p class="summary">', F.col("c_mktsegment"), '</p><div class="contact vcard"><object class="include" data="#holder"></object></div></div>')
    found = microformats.records(c.select("c_custkey", html.alias("html")), "hresume", ["c_custkey"])
    contact = F.get(F.filter("children", lambda x: x["name"] == "contact"), F.lit(0))["fields"]["fn"]
    return found.select("c_custkey", F.col("fields")["summary"].alias("summary"), contact.alias("contact"))


@query("""SELECT p_partkey, p_name AS summary, CAST(p_size AS VARCHAR) || ' EUR' AS price, '2024-02-0' || (p_size % 9 + 1) AS listed, p_brand AS item, 'anonymous' AS lister FROM part""")
def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J26."""
    p = spread(read(spark, sf_dir, "part"))
    html = _markup('<div class="hlisting"><b class="summary">', F.col("p_name"), '</b><i class="price">', F.col("p_size"), ' EUR</i><abbr class="dtlisted" title="2024-02-0', F.col("p_size") % 9 + 1, '">then</abbr><span class="item vcard"><span class="fn">', F.col("p_brand"), "</span></span></div>")
    found = microformats.records(p.select("p_partkey", html.alias("html")), "hlisting", ["p_partkey"])
    child = lambda name: F.get(F.filter("children", lambda x: x["name"] == name), F.lit(0))["fields"]["fn"]
    f = F.col("fields")
    return found.select("p_partkey", f["summary"].alias("summary"), f["price"].alias("price"), f["dtlisted"].alias("listed"), child("item").alias("item"), child("lister").alias("lister"))


@query("""WITH o AS (SELECT 'r' || r_regionkey AS id, r_name AS name, NULL AS place FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, CASE WHEN n_nationkey % 4 = 0 THEN 'nowhere' ELSE 'r' || n_regionkey END FROM nation)
SELECT o.id, o.name, coalesce(t.name, o.place) AS place FROM o LEFT JOIN o t ON o.place = t.id""")
def inlined_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of what a reference means stands in its place; references to nothing stay."""
    r = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("place"))
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), "n_name", F.when(F.col("n_nationkey") % 4 == 0, "nowhere").otherwise(F.concat(F.lit("r"), "n_regionkey")))
    return entities.inline_references(r.union(n), "id", "place").select("id", "name", "place")


@query("""SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY (event_id % 10) DESC, event_id DESC) AS entities FROM events GROUP BY user_id""")
def entities_by_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ascending, then reversed, so that ties come last first."""
    told = F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_id") % 10 / 10).alias("relevance"))))
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(told.alias("found"))
    return e.select("user_id", F.array_join(F.transform(entities.by_relevance(F.col("found")), lambda x: x["event_id"].cast("string")), ",").alias("entities"))


@query("""SELECT c_custkey, 'From <a href="u:' || c_custkey || '">' || c_name || '</a> of <a href="u:seg">' || c_mktsegment || '</a>.' AS html FROM customer""")
def linked_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4, I102: anchors around mentions by their offsets, from the last to the first."""
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    text = F.concat(F.lit("From "), name, F.lit(" of "), seg, F.lit("."))
    one = F.struct(F.lit(5).alias("offset"), F.length(name).alias("length"), F.concat(F.lit("u:"), F.col("c_custkey")).alias("uri"))
    two = F.struct((F.lit(9) + F.length(name)).alias("offset"), F.length(seg).alias("length"), F.lit("u:seg").alias("uri"))
    return read(spark, sf_dir, "customer").select("c_custkey", entities.link_mentions(text, F.array(one, two)).alias("html"))


@query("""SELECT doc_id, concat_ws(' ', source, text) AS analysed, length(concat_ws(' ', source, text)) >= 100 AS long_enough FROM documents""")
def analysis_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I105, C10."""
    text = store.analysis_text(F.col("source"), F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", text.alias("analysed"), entities.analysable(text).alias("long_enough"))


@query("""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, regexp_replace(url, '^[A-Za-z]+://[^/?#]*', '') AS rest FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'http://' || host || rest WHEN 1 THEN 'http://' || host || rest WHEN 2 THEN scheme || '://' || host || rest WHEN 3 THEN host || rest ELSE scheme || '://' || host END AS normal FROM p""")
def normal_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' addresses behind feed prefixes, with a port, in capitals, without a scheme or path."""
    p = read(spark, sf_dir, "pages")
    host, scheme = F.lower(urls.authority(F.col("url"))), urls.scheme(F.col("url"))
    rest = F.regexp_replace("url", "^[A-Za-z]+://[^/?#]*", "")
    forms = (
        F.concat(F.lit("feed://https//"), host, rest), F.concat(F.lit("feed://"), F.upper(host), F.lit(":80"), rest), F.concat(F.upper(scheme), F.lit("://"), F.initcap(host), F.lit(":80"), rest),
        F.concat(host, rest), F.concat(scheme, F.lit("://"), F.upper(host), F.lit("#")),
    )
    return p.select("page_id", urls.normalize(F.element_at(F.array(*forms), (F.col("page_id") % 5 + 1).cast("int"))).alias("normal"))


@query("""SELECT s_suppkey, CAST(i AS INTEGER) AS pos, CASE i WHEN 0 THEN '/big' || s_suppkey || '.png' WHEN 1 THEN '/plain.png' END AS src FROM supplier, (SELECT unnest([0, 1]) AS i)""")
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small images and repeats go."""
    html = _markup('<img src="/big', F.col("s_suppkey"), '.png" width="16" height="20"><img width=15 src="/thin.png"><img src="/plain.png"><img height="1" src="/low.png"><img src="/plain.png" alt="again">')
    return pages.images(read(spark, sf_dir, "supplier").select("s_suppkey", html.alias("html")), "s_suppkey")


@query("""SELECT s_suppkey, '<html><head><meta charset="utf-8"><title>' || s_name || '</title></head><body><a href="http://h.example/d/' || s_suppkey || '">x</a><img src="http://h.example/i.png"></body></html>' AS html FROM supplier""")
def resolved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute links, and a charset declaration first in the head."""
    html = _markup("<html><head><title>", F.col("s_name"), '</title></head><body><a href="../d/', F.col("s_suppkey"), '">x</a><img src="/i.png"></body></html>')
    change = lambda t: html_tree.with_charset(html_tree.resolve_links(t, "http://h.example/e/f"))
    return parse_column(read(spark, sf_dir, "supplier").select("s_suppkey", html.alias("raw")), "raw", change, "html", "string").drop("raw")


@query("""SELECT c_custkey, '<form><input name="who" value="Ann"><input type="checkbox" name="seg" value="' || c_mktsegment || '"' || CASE WHEN c_mktsegment = 'BUILDING' THEN ' checked=""' ELSE '' END
  || '><textarea name="note">n &lt; 1</textarea><select name="size"><option value="s">S</option><option selected="">m</option></select></form>' AS html FROM customer""")
def filled_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I44."""
    html = _markup('<form><input name="who"><input type="checkbox" name="seg" value="', F.col("c_mktsegment"), '" checked><textarea name="note">old</textarea><select name="size"><option value="s" selected>S</option><option>m</option></select></form>')
    fill = lambda t: html_tree.fill_form(t, {"who": "Ann", "seg": "BUILDING", "note": "n < 1", "size": "m"})
    return parse_column(spread(read(spark, sf_dir, "customer").select("c_custkey", html.alias("raw"))), "raw", fill, "html", "string").drop("raw")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) SELECT n_regionkey, CAST(i - 2 AS INTEGER) AS pos, n_name AS title, CAST(n_nationkey AS VARCHAR) AS number FROM n WHERE i BETWEEN 2 AND 4""")
def table_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header of two lines, of which the first names a column where it can; one row skipped, three at most."""
    lines = F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat(F.lit('"'), "n_name", F.lit('",'), "n_nationkey").alias("line"))))
    csv = F.concat(F.lit("title,\nignored,number\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n"))
    texts = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(csv.alias("csv"))
    found = tables.read_tables(texts, "csv", (0, 1), 1, 3)
    return found.select("n_regionkey", F.posexplode("rows").alias("pos", "r")).select("n_regionkey", "pos", F.col("r")["title"].alias("title"), F.col("r")["number"].alias("number"))


@query("""WITH d AS (SELECT c_custkey AS id, c_name AS title, c_mktsegment AS seg FROM customer), t AS (SELECT * FROM d ORDER BY title, id LIMIT 5 OFFSET 5),
f AS (SELECT seg, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, seg) AS rank FROM d GROUP BY seg)
SELECT 5 AS n_articles, (SELECT title FROM t ORDER BY title LIMIT 1) AS first_title, (SELECT seg FROM f WHERE rank = 1) AS top_value, (SELECT n FROM f WHERE rank = 1) AS top_n, 1 AS previous, 3 AS following, CAST(ceil((SELECT count(*) FROM d) / 5) AS INTEGER) AS pages""")
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of results as JSON texts, read back."""
    docs = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.array("c_mktsegment").alias("tags"))
    facets = search.facet_top(search.facet_counts(docs, ("tags",)))
    out = search.result_json(search.page(docs, [F.col("title"), F.col("id")], 2, 5), facets, docs.count(), 2, 5)
    part = lambda c, p: F.get_json_object(c, p)
    return out.select(
        F.json_array_length("articles").alias("n_articles"), part("articles", "$[0].title").alias("first_title"), part("facets", "$[0].values[0].value").alias("top_value"), part("facets", "$[0].values[0].n").cast("long").alias("top_n"),
        part("pages", "$.previous").cast("int").alias("previous"), part("pages", "$.next").cast("int").alias("following"), part("pages", "$.pages").cast("int").alias("pages"),
    )


@query("""SELECT conv_id, list(role ORDER BY turn, role, text)[1] AS first_role, list(role ORDER BY turn, role, text)[2] AS second_role, CAST(count(*) AS INTEGER) AS n, CAST(NULL AS VARCHAR) AS nothing FROM conversations GROUP BY conv_id""")
def typed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list met by name means its first element, [0] of a record the record."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    df = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.struct(turns.alias("turns"), F.struct(F.count(F.lit(1)).cast("int").alias("size")).alias("about")).alias("talk"))
    at = lambda path: coerce.extract(df, path)
    return df.select("conv_id", at("talk.turns.role").alias("first_role"), at("talk.turns[1].role").alias("second_role"), at("talk.about[0].size").alias("n"), at("talk.none.role").cast("string").alias("nothing"))


_LINKS = ("http://H.example/a.RSS", "http://h.example/x/feed.atom", "http://o.example/myxml.html", "http://feeds.feedburner.com/z", "http://h.example/rss/", "http://h.example/xml-rss")


@query("""SELECT page_id, page_id % 6 = 0 AS feed, page_id % 6 IN (0, 5) AS xml, page_id % 6 IN (0, 1, 4, 5) AS here, page_id % 6 = 3 AS burner, page_id % 3 = 0 AS rss, page_id % 3 = 1 AS opml FROM pages""")
def link_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What links and openings of texts say of their contents."""
    link = F.element_at(F.array(*map(F.lit, _LINKS)), (F.col("page_id") % 6 + 1).cast("int"))
    raw = F.element_at(F.array(F.lit("<?xml?><RSS>"), F.lit("<OPML><body/>"), F.lit("<HTML><rss><opml>")), (F.col("page_id") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select(
        "page_id", urls.is_feed_link(link).alias("feed"), urls.is_xml_related(link).alias("xml"), urls.is_local_link(link, F.lit("HTTP://h.Example/")).alias("here"), urls.is_burner_link(link).alias("burner"),
        pages.is_rss(raw).alias("rss"), pages.is_opml(raw).alias("opml"),
    )


@query("""SELECT event_id, lag(event_type) OVER w AS previous, lead(event_type) OVER w AS following FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def neighbouring_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("event_id", *[c.alias(k) for k, c in runs.neighbours(F.col("event_type"), w).items()])


@query("""SELECT 'http://f.example/' || s_suppkey AS href, s_acctbal AS headlines_rank FROM supplier ORDER BY headlines_rank DESC, href""")
def ranked_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5."""
    return pages.ranked_feeds(read(spark, sf_dir, "supplier").select(F.concat(F.lit("http://f.example/"), "s_suppkey").alias("href"), F.col("s_acctbal").alias("headlines_rank")))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'u:loose' ELSE 'u:' || c_custkey || ',u:loose' END AS loose FROM customer""")
def loose_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5."""
    own = F.concat(F.lit("u:"), F.col("c_custkey"))
    fields = F.create_map(F.lit("fn"), "c_name", F.lit("url"), F.when(F.col("c_custkey") % 2 == 0, own).otherwise("u:other"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(records.loose(F.array(own, F.lit("u:loose"), own), fields), ",").alias("loose"))


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def sites_without_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3."""
    return store.without_children(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), read(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'""")
def rows_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups that reach the scan."""
    return store.by_key(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), o_custkey=7, o_orderstatus="F")
