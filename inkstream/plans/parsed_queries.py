"""Queries over parsers and streams. Rows are rendered as markup, feeds or tables, read back and compared with what
they were made from, so that SQL over the source columns checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions import variants
from inkstream.functions.text import escape_html
from inkstream.plans.base import NOW, dealt, query, read, spread
from inkstream.shared import shared_dir
from inkstream.sources import connectors, feeds, html_tree, microformats, objects, tables, xml_rows
from inkstream.sources.arrow import parse_column
from inkstream.streaming import crawl, refresh


def _markup(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else escape_html(p.cast("string")) for p in parts])


@query("""SELECT s_suppkey, s_name AS fn, 'Supplier' AS org, 'city' || CAST(s_nationkey AS VARCHAR) AS locality, CAST(s_suppkey AS VARCHAR) AS tel, 'http://example.com/' || CAST(s_suppkey AS VARCHAR) AS url, 's' || CAST(s_suppkey AS VARCHAR) || '@example.com' AS email FROM supplier""")
def hcard_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J22."""
    s = spread(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"))
    k = F.col("s_suppkey")
    html = _markup('<div class="vcard"><a class="url fn" href="http://example.com/', k, '">', F.col("s_name"), '</a><span class="org">Supplier</span><p class="adr"><span class="type">work</span> <span class="locality">city', F.col("s_nationkey"), '</span></p><p class="tel"><span class="type">work</span> <b class="value">', k, '</b></p><a class="email" href="mailto:s', k, '@example.com?x=1">mail</a></div>')
    f = lambda name: F.try_element_at("fields", F.lit(name))
    found = microformats.records(s.select("s_suppkey", html.alias("html")), "hcard", ["s_suppkey"])
    return found.select("s_suppkey", f("fn").alias("fn"), f("org.organization-name").alias("org"), f("adr.work.locality").alias("locality"), f("tel.work").alias("tel"), f("url").alias("url"), f("email").alias("email"))


@query("""SELECT o_orderkey, 1 AS n, 'Order ' || CAST(o_orderkey AS VARCHAR) AS title, '<p>' || o_orderpriority || '</p>' || chr(10) || o_orderstatus AS content, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS published, '/o/' || CAST(o_orderkey AS VARCHAR) AS bookmark, 'Customer ' || CAST(o_custkey AS VARCHAR) AS author, lower(o_orderstatus) AS tag FROM orders""")
def hatom_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry with an author, nested and quoted entries left out."""
    o, k = spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate")), F.col("o_orderkey")
    html = _markup('<div class="hfeed"><div class="hentry"><h2 class="entry-title">Order ', k, '</h2><div class="entry-content"><p>', F.col("o_orderpriority"), '</p></div><div class="entry-content">', F.col("o_orderstatus"), '</div><abbr class="published" title="', F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), '">then</abbr><a rel="bookmark" href="/o/', k, '">#</a><span class="author vcard"><span class="fn">Customer ', F.col("o_custkey"), '</span></span><a rel="tag" href="/tags/', F.lower("o_orderstatus"), '/">t</a><div class="hentry"><b class="entry-title">inner</b></div></div><blockquote><div class="hentry"><b class="entry-title">quoted</b></div></blockquote></div>')
    f = lambda name: F.try_element_at("fields", F.lit(name))
    child = lambda name, key: F.try_element_at(F.get(F.filter("children", lambda c: c["name"] == name), F.lit(0))["fields"], F.lit(key))
    found = microformats.microformats(o.select("o_orderkey", html.alias("html")), "html", ("hatom",))
    found = found.select("o_orderkey", F.size("records").alias("n"), F.explode("records").alias("r")).select("o_orderkey", "n", "r.fields", "r.children")
    return found.select("o_orderkey", "n", f("entry-title").alias("title"), f("entry-content").alias("content"), f("published").alias("published"), f("bookmark").alias("bookmark"), child("author", "fn").alias("author"), child("tag", "name").alias("tag"))


@query("""SELECT event_id, event_type AS summary, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS dtstart, lpad(CAST(user_id % 30 AS VARCHAR), 2, '0') || ':30:00' AS duration FROM events""")
def hcalendar_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J23, I83."""
    e = spread(read(spark, sf_dir, "events").select("event_id", "event_type", "ts", "user_id"))
    stop = F.col("ts") + F.make_dt_interval(hours=(F.col("user_id") % 30).cast("int"), mins=F.lit(30))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    html = _markup('<ul><li class="vevent"><b class="summary">', F.col("event_type"), '</b><abbr class="dtstart" title="', shown(F.col("ts")), '">a</abbr><abbr class="dtend" title="', shown(stop), '">b</abbr></ul>')
    found = microformats.records(e.select("event_id", html.alias("html")), "hcalendar", ["event_id"])
    return found.select("event_id", F.col("fields")["summary"].alias("summary"), F.col("fields")["dtstart"].alias("dtstart"), F.try_element_at("fields", F.lit("@duration")).alias("duration"))


@query("""SELECT p_partkey, p_name AS item, CAST(p_size % 5 + 1 AS VARCHAR) AS rating, 'anonymous' AS reviewer, 'http://example.com/x' AS url, p_brand AS title, '60' AS ttl, 'red' AS tag FROM part""")
def reviews_and_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several formats from one parse."""
    p = spread(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand"))
    html = _markup('<div class="hreview"><div class="item"><span class="fn">', F.col("p_name"), '</span></div><span class="rating">', F.col("p_size") % 5 + 1, '</span></div><div class="xfolkentry"><a class="taggedlink" href="http://example.com/x">', F.col("p_brand"), '</a></div><div class="hslice"><i class="ttl">60 minutes</i></div><a rel="tag" href="/t/red">r</a>')
    found = microformats.microformats(p.select("p_partkey", html.alias("html")), "html", ("hreview", "xfolk", "webslice", "rel-tag"))
    one = lambda name: F.get(F.filter("records", lambda r: r["format"] == name), F.lit(0))
    child = lambda name: F.get(F.filter(one("hreview")["children"], lambda c: c["name"] == name), F.lit(0))["fields"]["fn"]
    return found.select("p_partkey", child("item").alias("item"), one("hreview")["fields"]["rating"].alias("rating"), child("reviewer").alias("reviewer"), one("xfolk")["fields"]["url"].alias("url"), one("xfolk")["fields"]["title"].alias("title"), one("hslice")["fields"]["ttl"].alias("ttl"), one("reltag")["fields"]["name"].alias("tag"))


_FEED_SQL = """SELECT o_custkey, o_orderkey, 'Order <' || CAST(o_orderkey AS VARCHAR) || '> & more' AS title, 'http://example.com/?o=' || CAST(o_orderkey AS VARCHAR) || '&x' AS link, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS updated FROM orders"""


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    o = dealt(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey")
    return o, F.concat(F.lit("Order <"), F.col("o_orderkey").cast("string"), F.lit("> & more")), F.concat(F.lit("http://example.com/?o="), F.col("o_orderkey").cast("string"), F.lit("&x"))


@query(_FEED_SQL)
def rss_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as an RSS document and back."""
    o, title, link = _items(spark, sf_dir)
    fields = {"title": title, "link": link, "guid": F.col("o_orderkey").cast("string"), "pubDate": F.col("o_orderdate")}
    docs = feeds.write_rss(o, ["o_custkey"], "o_orderkey", F.lit("Orders"), fields)
    return feeds.entries(docs, "rss", ["o_custkey"]).select("o_custkey", F.col("id").cast("long").alias("o_orderkey"), "title", "link", "updated")


@query(_FEED_SQL)
def rss_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents read by the schema of their kind, without Python."""
    o, title, link = _items(spark, sf_dir)
    fields = {"title": title, "link": link, "guid": F.col("o_orderkey").cast("string"), "pubDate": F.col("o_orderdate")}
    docs = feeds.write_rss(o, ["o_custkey"], "o_orderkey", F.lit("Orders"), fields)
    return xml_rows.rss_entries(docs, "rss", ["o_custkey"]).select("o_custkey", F.col("id").cast("long").alias("o_orderkey"), "title", "link", "updated")


@query("""SELECT c_custkey, c_name AS given, CAST(round(c_acctbal) AS BIGINT) AS balance, c_mktsegment AS first_tag, 'b' AS second_tag FROM customer""")
def xml_by_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects as XML, read by a schema that an example gave once."""
    c = read(spark, sf_dir, "customer")
    xml = _markup('<c xmlns="urn:x" balance="', F.round("c_acctbal").cast("long"), '"><Name>', F.col("c_name"), "</Name><tag>", F.col("c_mktsegment"), "</tag><tag>b</tag></c>")
    schema = xml_rows.infer(spark, '<c balance="1"><Name>n</Name><tag>a</tag><tag>b</tag></c>')
    row = xml_rows.parse(F.col("xml"), schema)
    found = c.select("c_custkey", xml.alias("xml")).select("c_custkey", row.alias("o"))
    return found.select("c_custkey", F.col("o.Name").alias("given"), F.col("o.`@balance`").cast("long").alias("balance"), F.get("o.tag", F.lit(0)).alias("first_tag"), F.get("o.tag", F.lit(1)).alias("second_tag"))


@query(_FEED_SQL)
def atom_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19-A23, B12."""
    o, title, link = _items(spark, sf_dir)
    fields = {"id": F.col("o_orderkey").cast("string"), "title": title, "link": link, "updated": F.col("o_orderdate")}
    docs = feeds.write_atom(o, ["o_custkey"], "o_orderkey", F.lit("Orders"), fields)
    return feeds.entries(docs, "atom", ["o_custkey"]).select("o_custkey", F.col("id").cast("long").alias("o_orderkey"), "title", "link", "updated")


@query("""SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS pos, n_name AS title, 'http://example.com/' || CAST(n_nationkey AS VARCHAR) AS uri FROM nation""")
def outline_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24, B13."""
    fields = {"text": F.col("n_name"), "url": F.concat(F.lit("http://example.com/"), F.col("n_nationkey").cast("string"))}
    docs = feeds.write_opml(read(spark, sf_dir, "nation"), ["n_regionkey"], "n_nationkey", F.lit("Nations"), fields)
    return tables.read_outlines(docs, "opml").select("n_regionkey", F.posexplode("outlines").alias("pos", "o")).select("n_regionkey", "pos", "o.title", "o.uri")


@query("""SELECT c_custkey, c_name AS given, CAST(round(c_acctbal) AS BIGINT) AS balance, c_mktsegment AS first_tag, 'b' AS second_tag FROM customer""")
def xml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects as XML, read as nested objects, taken by path."""
    c = read(spark, sf_dir, "customer")
    xml = _markup('<c xmlns="urn:x" balance="', F.round("c_acctbal").cast("long"), '"><Name>', F.col("c_name"), "</Name><tag>", F.col("c_mktsegment"), "</tag><tag>b</tag></c>")
    found = objects.objects(c.select("c_custkey", xml.alias("xml")), "xml", "xml")
    path = lambda p: F.get_json_object("object", p)
    return found.select("c_custkey", path("$.c.Name").alias("given"), path("$.c['@balance']").cast("long").alias("balance"), path("$.c.tag[0]").alias("first_tag"), path("$.c.tag[1]").alias("second_tag"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS event_type FROM events""")
def jsonp_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON in a call, keys as slugs, empty texts left out."""
    e = spread(read(spark, sf_dir, "events").select("event_id", "event_type", "props"))
    text = F.concat(F.lit('cb({"Event Type":"'), "event_type", F.lit('","None":"","Props":'), "props", F.lit("});"))
    found = e.select("event_id", variants.parse(text).alias("v"))
    return found.select("event_id", variants.text(variants.at(F.col("v"), "Props.k")).alias("k"), variants.text(variants.at(F.col("v"), "Event_Type")).alias("event_type"))


@query("""WITH i AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)
SELECT o_custkey, CAST(n // 4 + 1 AS INTEGER) AS page, CAST(n AS INTEGER) AS index, CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS priority FROM i WHERE n < 12""")
def variant_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of saved pages as variants, at most 3 pages, numbered over all of them."""
    from pyspark.sql.window import Window

    o = dealt(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey").withColumn("page", F.floor((F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1) / 4).cast("int") + 1)
    listed = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("Order Key"), F.col("o_orderpriority").alias("order-priority"))))
    pages = o.groupBy("o_custkey", "page").agg(F.concat(F.lit("cb("), F.to_json(F.struct(F.struct(listed.alias("item")).alias("Result Set"))), F.lit(");")).alias("payload"))
    found = variants.items(pages, "payload", ["o_custkey"], "page", "Result_Set.item")
    return found.select("o_custkey", "page", "index", *[variants.text(variants.at(F.col("item"), p)).alias(n) for n, p in (("key", "Order_Key"), ("priority", "order_priority"))])


@query("""SELECT n_nationkey, n_name AS name, r_name AS home, CASE WHEN n_nationkey % 4 = 0 THEN 'nowhere' ELSE r_name END AS said FROM nation JOIN region ON r_regionkey = n_regionkey""")
def entity_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of one answer, with what they refer to in place of references."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    place = F.concat(F.lit("urn:r"), F.col("n_regionkey").cast("string"))
    of = lambda **f: F.struct(*[v.alias(k) for k, v in f.items()])
    nation = of(name=F.col("n_name"), home=place, said=F.when(F.col("n_nationkey") % 4 == 0, "nowhere").otherwise(place))
    answer = F.concat(F.lit('{"urn:n":'), F.to_json(nation), F.lit(',"'), place, F.lit('":'), F.to_json(of(name=F.col("r_name"))), F.lit("}"))
    found = F.element_at(variants.inlined(variants.parse(answer)), F.lit("urn:n"))
    said = F.element_at(found, F.lit("said"))
    return n.select("n_nationkey", variants.text(F.element_at(found, F.lit("name"))).alias("name"), variants.text(variants.at(F.element_at(found, F.lit("home")), "name")).alias("home"), F.coalesce(variants.text(variants.at(said, "name")), variants.text(said)).alias("said"))


@query("""SELECT c_nationkey, CAST((row_number() OVER w - 1) // 5 + 1 AS INTEGER) AS page, CAST(row_number() OVER w - 1 AS INTEGER) AS index, c_name AS title FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey) QUALIFY row_number() OVER w <= 12""")
def paged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved pages of a connector, at most 3 pages and 12 items."""
    from pyspark.sql.window import Window

    c = read(spark, sf_dir, "customer").withColumn("page", F.floor((F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1) / 5).cast("int") + 1)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: F.struct(x["c_name"].alias("name"), x["c_custkey"].alias("pid")))
    payload = F.to_json(F.struct(F.struct(F.struct(listed.alias("merchant")).alias("merchants"), F.struct(F.lit("9").alias("page_count")).alias("pagination")).alias("community")))
    pages = c.groupBy("c_nationkey", "page").agg(payload.alias("payload"))
    found = connectors.items(pages, "payload", "merchants", ["c_nationkey"], "page", page_limit=3, item_limit=12)
    return found.select("c_nationkey", "page", "index", F.get_json_object("item", "$.title").alias("title"))


@query("""SELECT s_suppkey, s_name AS fn, 's' || CAST(s_suppkey AS VARCHAR) || '@example.com' AS email, CAST(s_nationkey AS VARCHAR) AS city, s_name || ', Esq.' AS card_fn, CAST(s_nationkey AS VARCHAR) AS card_city FROM supplier""")
def contacts_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts as a table and as cards."""
    s = read(spark, sf_dir, "supplier")
    table = F.concat(F.lit("Name,E-mail Address,Business City\n"), "s_name", F.lit(",s"), F.col("s_suppkey").cast("string"), F.lit("@example.com,"), F.col("s_nationkey").cast("string"))
    card = F.concat(F.lit("BEGIN:VCARD\r\nVERSION:3.0\r\nFN:"), "s_name", F.lit("\\,\r\n  Esq.\r\nADR;TYPE=work:;;;"), F.col("s_nationkey").cast("string"), F.lit(";;;\r\nEND:VCARD\r\n"))
    both = tables.read_cards(tables.read_contacts(s.select("s_suppkey", table.alias("t"), card.alias("c")), "t"), "c")
    at = lambda c, k: F.try_element_at(F.get(c, F.lit(0)), F.lit(k))
    return both.select("s_suppkey", at("contacts", "fn").alias("fn"), at("contacts", "email").alias("email"), at("contacts", "adr.work.locality").alias("city"), at("cards", "fn").alias("card_fn"), at("cards", "adr.work.locality").alias("card_city"))


@query("""SELECT conv_id, turn, 'Turn ' || CAST(turn AS VARCHAR) AS subject, role || '@example.com' AS sender, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations""")
def mail_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A26."""
    c = read(spark, sf_dir, "conversations")
    body = F.base64(F.trim(F.regexp_replace("text", r"\s+", " ")).cast("binary"))
    text = F.concat(F.lit("From: "), "role", F.lit("@example.com\nTo: a@example.com\nSubject: Turn "), F.col("turn").cast("string"), F.lit('\nMIME-Version: 1.0\nContent-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: base64\n\n'), body, F.lit("\n"))
    return tables.read_mail(c.select("conv_id", "turn", text.alias("m")), "m").select("conv_id", "turn", "mail.subject", "mail.sender", "mail.text")


@query("""SELECT doc_id, text AS decoded FROM documents""")
def decoded_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8 and declared Latin-1 bytes by the ladder of declarations; Latin-1 where it has all letters."""
    d = read(spark, sf_dir, "documents")
    narrow = (F.col("doc_id") % 2 == 1) & F.col("text").rlike(r"^[\x00-\x7F\xA0-\xFF]*$")
    raw = F.when(narrow, F.encode(F.concat(F.lit('<meta charset="iso-8859-1">'), "text"), "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    found = tables.decode_bytes(d.select("doc_id", raw.alias("raw")), "raw")
    return found.select("doc_id", F.regexp_replace("decoded", "^<meta[^>]*>", "").alias("decoded"))


@query()
def sanitized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe markup, tokens and problems of each page."""
    p = read(spark, sf_dir, "pages").select("page_id", "html")
    told = parse_column(p, "html", html_tree.checked, "c", "struct<safe:string,tokens:array<string>,problems:array<string>>")
    return told.select("page_id", F.sha2("c.safe", 256).alias("safe_sha256"), F.size("c.tokens").alias("n_tokens"), F.size("c.problems").alias("n_problems"))


def _checkpoint(spark: SparkSession) -> str:
    """A folder of its own within the shared one."""
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    return crawl.read_stream(spark, f"{sf_dir}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id""")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K: each key's first row, written by idempotent batches of a stream."""
    at = _checkpoint(spark)
    crawl.finish(_events(spark, sf_dir).select("user_id", "event_id"), f"{at}/log", crawl.upsert_into(f"{at}/table", ["user_id"], ["event_id"]))
    return crawl.upserted(spark, f"{at}/table", "user_id long, event_id long")


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K: counts by day over a stream with a watermark; all windows of the finite input."""
    at = _checkpoint(spark)
    counts = crawl.windowed_counts(_events(spark, sf_dir), "ts", "event_type")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/table/batch={number}")

    crawl.finish(counts, f"{at}/log", write, mode="complete")
    return spark.read.schema("start timestamp, event_type string, n long").parquet(f"{at}/table/batch=0")


@query("""WITH RECURSIVE due AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
UNION ALL SELECT user_id, ts FROM (SELECT e.user_id, e.ts, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts) AS i FROM due d JOIN events e ON e.user_id = d.user_id AND e.ts >= d.ts + INTERVAL 120 MINUTE) WHERE i = 1)
SELECT user_id, ts FROM due""")
def stream_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K: events of a user at least 120 minutes apart, with the time of the next as state; what the watermark has not passed at the
    end of the finite input is taken from the state."""
    at = _checkpoint(spark)
    due = refresh.refreshes(_events(spark, sf_dir).select("user_id", "ts"), "user_id", "ts")
    crawl.finish(due, f"{at}/log", lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/table/batch={n}"))
    passed = spark.read.schema("user_id long, ts timestamp").parquet(f"{at}/table/batch=*")
    return passed.unionByName(refresh.remaining(spark, f"{at}/log", "user_id", "ts").select("user_id", "ts"))


@query(f"""SELECT event_id, epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) < 300 AS fresh FROM events WHERE epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) < 2592000""")
def usable_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K: cached pages that may be used, and whether they are fresh."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").alias("fetched_at"))
    return crawl.usable_cache(e, F.lit(NOW).cast("timestamp")).select("event_id", "fresh")
