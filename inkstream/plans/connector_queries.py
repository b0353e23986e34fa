"""Queries over saved payloads of web services: items, totals, what holds for all items, details of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.plans.base import query, read, spread
from inkstream.plans.parsed_queries import _markup
from inkstream.sources import connectors


def _json(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _item(path: str, of: str = "item") -> Column:
    return F.get_json_object(of, path)


@query("""WITH p AS (SELECT s_suppkey AS k, s_name AS name, i AS page FROM supplier, (SELECT unnest([1, 2, 3]) AS i)),
i AS (SELECT k, page, name, j, row_number() OVER (PARTITION BY k ORDER BY page, j) - 1 AS index FROM p, (SELECT unnest([0, 1]) AS j) WHERE page <= greatest(k % 4, 1))
SELECT k, CAST(page AS INTEGER) AS page, CAST(index AS INTEGER) AS index, 'a' || k || '-' || page || '-' || j AS asin, CASE WHEN j = 0 THEN name END AS title, CAST(k % 4 AS VARCHAR) AS total FROM i WHERE index < 3""")
def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of products up to the total that the first tells, items up to theirs, and what holds for all."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n"))
    item = lambda j: ["<Item><ASIN>a", F.col("k"), "-", F.col("n"), f"-{j}</ASIN>"]
    xml = _markup("<ItemSearchResponse xmlns='urn:x'><Items><Request><Total>", F.col("k") % 4, "</Total></Request><TotalPages>", F.col("k") % 4, "</TotalPages><TotalResults>3</TotalResults>", *item(0), "<Title>", F.col("s_name"), "</Title></Item>", *item(1), "</Item></Items></ItemSearchResponse>")
    pages = spread(s.select("k", "n", xml.alias("xml")))
    found = connectors.items(pages, "xml", "products", ["k"], "n", page_limit=-1)
    told = connectors.meta(pages, "xml", "products", ["k"], "n")
    return found.join(told, "k").select("k", "page", "index", _item("$.ASIN").alias("asin"), _item("$.Title").alias("title"), _item("$.Total", "meta").alias("total"))


@query("""SELECT c_custkey, c_name AS title, '<b>' || c_name || '</b>' AS formatted, 'http://h.example/' || c_custkey AS link, 'Town' AS city, '123' AS tel, '9' AS fax, CASE WHEN c_custkey % 2 = 0 THEN '[1.5,-2.0]' END AS point, 'local' AS kind, false AS left_over FROM customer""")
def local_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local search results with their cards and places."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    text = _json('{"responseData":{"results":[{"title":"<b>', F.col("c_name"), '</b>","titleNoFormatting":"', F.col("c_name"), '","url":"http://h.example/', k, '","lat":"', F.when(k % 2 == 0, "1.5").otherwise("x"), '","lng":"-2","city":"Town","phoneNumbers":[{"type":"main","number":"123"},{"type":"fax","number":"9"}],"listingType":"local"}]}}')
    found = connectors.items(spread(c.select("c_custkey", text.alias("t"))).withColumn("n", F.lit(1)), "t", "search.local", ["c_custkey"], "n")
    hcard = lambda name: _item(f"$['hcard:hcard']['{name}']")
    return found.select(
        "c_custkey", _item("$.title").alias("title"), _item("$['gsearch:gsearch'].titleFormatted").alias("formatted"), _item("$.link").alias("link"), hcard("adr.work.locality").alias("city"), hcard("tel.voice.work").alias("tel"), hcard("tel.fax.work").alias("fax"),
        F.replace(_item("$['georss:point']"), F.lit(" "), F.lit("")).alias("point"), _item("$['gsearch:gsearch'].listingType").alias("kind"), (_item("$.city").isNotNull() | _item("$.lat").isNotNull()).alias("left_over"),
    )


@query("""SELECT s_suppkey, s_name AS title, 'http://h.example/' || s_suppkey AS link, '2009-01-02T03:04:05+0000' AS updated, 'a' AS first_term, 'n' || s_nationkey AS second_term, 'u' || s_suppkey || ': x' AS meta_title, 'http://delicious.com/u' || s_suppkey || '/' AS meta_link, false AS posts_in_meta FROM supplier""")
def bookmarked_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks, and what is said of the list without its posts."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    xml = _markup('<posts user="u', k, '" tag="x" dt="2009-01-02T03:04:05Z"><post href="http://h.example/', k, '" description="', F.col("s_name"), '" hash="h" extended="e" tag="a n', F.col("s_nationkey"), '" time="2009-01-02T03:04:05Z"/></posts>')
    pages = s.select("s_suppkey", xml.alias("xml"), F.lit(1).alias("n"))
    found = connectors.items(pages, "xml", "bookmarks.recent", ["s_suppkey"], "n").join(connectors.meta(pages, "xml", "bookmarks.recent", ["s_suppkey"], "n"), "s_suppkey")
    return found.select(
        "s_suppkey", _item("$.title").alias("title"), _item("$.link").alias("link"), _item("$.updated").alias("updated"), _item("$.category[0].term").alias("first_term"), _item("$.category[1].term").alias("second_term"),
        _item("$.title", "meta").alias("meta_title"), _item("$.link", "meta").alias("meta_link"), _item("$.post", "meta").isNotNull().alias("posts_in_meta"),
    )


@query("""SELECT p_partkey, p_name AS title, 'm' || p_partkey AS id, 'big' AS photo, 'Words' AS content FROM part""")
def artist_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a music service tells of an artist."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    xml = _markup("<lfm status='ok'><artist><name>", F.col("p_name"), "</name><mbid>m", k, "</mbid><image>small</image><image>big></image><bio><content>Words</content></bio></artist></lfm>")
    found = connectors.items(spread(p.select("p_partkey", xml.alias("xml"))).withColumn("n", F.lit(1)), "xml", "music.info", ["p_partkey"], "n")
    return found.select("p_partkey", _item("$.title").alias("title"), _item("$.id").alias("id"), _item("$.photo").alias("photo"), _item("$.content").alias("content"))


@query("""SELECT n_nationkey, CASE i WHEN 0 THEN n_name ELSE 'World' END AS title, CASE WHEN i = 0 THEN '[' || n_nationkey || '.5,-1.0]' END AS point, i = 1 AS has_geometry, CAST(i AS INTEGER) AS index FROM nation, (SELECT unnest([0, 1]) AS i)""")
def place_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hierarchy of places; points become coordinates, other shapes stay."""
    n = read(spark, sf_dir, "nation")
    text = _json('{"user":{"location_hierarchy":[{"name":"', F.col("n_name"), '","geometry":{"type":"Point","coordinates":[', F.col("n_nationkey"), '.5,-1]}},{"name":"World","geometry":{"type":"Polygon","coordinates":[]}}]}}')
    found = connectors.items(n.select("n_nationkey", text.alias("t"), F.lit(1).alias("n")), "t", "location", ["n_nationkey"], "n")
    return found.select("n_nationkey", _item("$.title").alias("title"), F.replace(_item("$['georss:point']"), F.lit(" "), F.lit("")).alias("point"), _item("$.geometry").isNotNull().alias("has_geometry"), "index")


@query("""SELECT n_regionkey, 'f' || n_nationkey AS hash, CASE WHEN n_nationkey % 5 = 1 THEN 'own' ELSE n_name END AS title, CASE WHEN n_nationkey % 5 <> 1 THEN CAST(n_nationkey AS VARCHAR) END AS rank FROM nation WHERE n_nationkey % 5 <> 0""")
def detailed_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions, each with what another service says of its feed."""
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    one = _markup("<subscription>", F.when(k % 5 != 0, _json("f", k)).otherwise(""), "|<title>own</title></subscription>")
    one = F.regexp_replace(one, r"<subscription>(.*)\|", "<subscription><feed-hash>$1</feed-hash>")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, one.alias("x")))), lambda x: x["x"]), "")
    pages = n.groupBy("n_regionkey").agg(F.concat(F.lit("<subscriptions>"), listed, F.lit("</subscriptions>")).alias("xml")).withColumn("n", F.lit(1))
    info = n.filter(k % 5 != 1).select(_json("f", k).alias("hash"), _markup("<feed><title>", F.col("n_name"), "</title><rank>", k, "</rank></feed>").alias("xml"), F.lit(1).alias("n"))
    details = connectors.meta(info, "xml", "feed_information", ["hash"], "n")
    found = connectors.with_details(connectors.items(pages, "xml", "subscriptions", ["n_regionkey"], "n"), details, "$['feed-hash']", "hash")
    return found.select("n_regionkey", _item("$['feed-hash']").alias("hash"), _item("$.title").alias("title"), _item("$.rank").alias("rank"))


@query("""SELECT s_suppkey, 'http://s.example/' || s_suppkey AS link, 'OK' AS status FROM supplier""")
def shortened_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer as a whole is the item."""
    s = read(spark, sf_dir, "supplier")
    text = _json('{"statusCode":"OK","results":{"http://long.example/":{"shortUrl":"http://s.example/', F.col("s_suppkey"), '"}}}')
    found = connectors.items(s.select("s_suppkey", text.alias("t"), F.lit(1).alias("n")), "t", "shortener", ["s_suppkey"], "n")
    return found.select("s_suppkey", F.regexp_extract(_item("$.results"), r'"shortUrl":\s*"([^"]*)"', 1).alias("link"), _item("$.statusCode").alias("status"))


@query("""SELECT c_custkey, c_name AS title, '[43.5,-79.25]' AS point, 'coffee' AS term, 'Town' AS city, '416' AS tel, 'http://s.example/' || c_custkey AS alternate, '1' AS total, false AS left_over FROM customer""")
def merchant_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchants with their tags, coordinates and cards."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    text = _json('{"community":{"pagination":{"page_count":"1"},"merchants":{"merchant":{"name":"', F.col("c_name"), '","pid":"p","phone":"416","location":{"city":{"name":"Town"},"latitude":"43.5","longitude":"-79.25"},"tags":{"tag":[{"name":"coffee"}]},"short_url":"http://s.example/', k, '"}}}}')
    pages = spread(c.select("c_custkey", text.alias("t"))).withColumn("n", F.lit(1))
    found = connectors.items(pages, "t", "merchants", ["c_custkey"], "n").join(connectors.meta(pages, "t", "merchants", ["c_custkey"], "n"), "c_custkey")
    hcard = lambda name: _item(f"$['hcard:hcard']['{name}']")
    return found.select(
        "c_custkey", _item("$.title").alias("title"), F.replace(_item("$['georss:point']"), F.lit(" "), F.lit("")).alias("point"), _item("$.category[0].term").alias("term"), hcard("adr.work.locality").alias("city"), hcard("tel.voice.work").alias("tel"),
        _item("$.links[0].href").alias("alternate"), _item("$.pagination.page_count", "meta").alias("total"), (_item("$.location").isNotNull() | _item("$.tags").isNotNull()).alias("left_over"),
    )


_ENDPOINTS = [n for n in connectors.CONNECTORS if n.split(".")[0] in ("search", "bookmarks", "music")]


@query(f"""SELECT e AS endpoint, s_suppkey AS k, s_name AS title, 'http://h.example/' || s_suppkey AS link FROM supplier, (SELECT unnest([{", ".join(f"'{n}'" for n in _ENDPOINTS)}]) AS e)""")
def all_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of every search, bookmark and music endpoint, by the paths and names of each."""
    s = spread(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name", F.lit(1).alias("n")))
    link, out = ("http://h.example/", F.col("k")), None
    for name in _ENDPOINTS:
        c = connectors.CONNECTORS[name]
        if c.kind == "json":
            text = _json('{"responseData":{"results":[{"titleNoFormatting":"', F.col("s_name"), '","url":"', *link, '"}]}}')
        elif name.startswith("bookmarks"):
            text = _markup('<posts><post description="', F.col("s_name"), '" href="', *link, '"/></posts>')
        else:
            path = c.items.split(".")
            opened, closed = "".join(f"<{p}>" for p in path), "".join(f"</{p}>" for p in reversed(path))
            text = _markup(f"<lfm>{opened}<name>", F.col("s_name"), "</name><url>", *link, f"</url>{closed}</lfm>")
        found = connectors.items(s.withColumn("t", text), "t", name, ["k"], "n")
        rows = found.select(F.lit(name).alias("endpoint"), "k", _item("$.title").alias("title"), _item("$.link").alias("link"))
        out = rows if out is None else out.unionByName(rows)
    return out
