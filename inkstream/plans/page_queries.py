"""Queries over web pages: URLs, titles, links, search documents, facets and ranked search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions import text as tx
from inkstream.functions import urls
from inkstream.operators import graph, pages, search, store
from inkstream.plans.base import NOW, query, read

_TITLE = r"trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<.*?>', '', 'g'), '\s+', ' ', 'g'))"
_H = r"trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h{0}[^>]*>(.*?)</h{0}>', 1), '<.*?>', '', 'g'), '\s+', ' ', 'g'))"
_HREFS = r"""regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1)"""
_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^(www|rss)\.', '')"


@query(rf"""SELECT page_id, {_TITLE} AS title, {_H.format(1)} AS h1, {_H.format(2)} AS h2, coalesce({", ".join(f"nullif({_H.format(n)}, '')" for n in range(1, 7))}, {_TITLE}) AS shown FROM pages""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J30."""
    h = F.col("html")
    return read(spark, sf_dir, "pages").select("page_id", pages.title(h).alias("title"), pages.heading(h, 1).alias("h1"), pages.heading(h, 2).alias("h2"), pages.document_title(h).alias("shown"))


@query(rf"""WITH l AS (SELECT page_id, {_HREFS} AS h FROM pages), n AS (SELECT page_id, h, unnest(generate_series(1, len(h))) AS i FROM l) SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, h[i] AS href FROM n""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J30, F2."""
    return pages.links(read(spark, sf_dir, "pages"))


@query(rf"""WITH l AS (SELECT page_id, list_transform({_HREFS}, lambda x: regexp_replace(x, '#.*$', '')) AS h FROM pages),
n AS (SELECT page_id, h, unnest(generate_series(1, len(h))) AS i FROM l), f AS (SELECT page_id, h[i] AS href, min(i) AS first FROM n WHERE h[i] <> '' GROUP BY ALL)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS INTEGER) AS pos, href FROM f""")
def page_links_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E11, I59."""
    return pages.distinct_links(read(spark, sf_dir, "pages"))


@query("""WITH l AS (SELECT page_id, list_value('/s' || page_id, '/b' || page_id, '/d' || page_id, '?a=1&p=' || page_id, '/u' || page_id, '/o' || page_id, url) AS h FROM pages), n AS (SELECT page_id, h, unnest(generate_series(1, 7)) AS i FROM l)
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, h[i] AS href, i = 4 AS is_next FROM n""")
def planted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in single quotes, bare, beside attributes and texts that look like one, not those of comments or
    other elements; of relations the very word."""
    k = F.col("page_id").cast("string")
    parts = [
        '<!-- <a href="/no1"> --><p><a href=\'/s', k, "'>x</a><a href=/b", k, ' class=y>y</a><a data-href="/no2" href="/d', k, '">z</a><a title="x > y href=\'/no3\'" href="?a=1&amp;p=', k,
        '" rel="prev NEXT">n</a><A id="q"HREF = "/u', k, '">u</A><link rel="next" href="/no4"><a rel="next-post" href="/o', k, '">o</a><abbr href="/no5">a</abbr><a name="no">b</a><a href="', F.col("url"), '">t</a>',
    ]
    planted = read(spark, sf_dir, "pages").select("page_id", F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts]).alias("html"))
    rel = F.filter(pages.tags(F.col("html"), "a"), lambda t: pages.has_token(pages.attribute(t, "rel"), "next"))
    following = F.transform(rel, lambda t: pages.attribute(t, "href"))
    found = planted.select("page_id", F.posexplode(pages.hrefs(F.col("html"))).alias("pos", "href"), following.alias("_next"))
    return found.select("page_id", "pos", "href", F.array_contains("_next", F.col("href")).alias("is_next"))


@query(r"""SELECT page_id, regexp_replace(html, '<.*?>', '', 'g') AS bare, length(html) AS n_html,
  contains(lower(substr(html, 1, 256)), '<html') OR contains(lower(substr(html, 1, 256)), '<!doctype html') AS is_html FROM pages""")
def stripped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I34, C25."""
    return read(spark, sf_dir, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("bare"), F.length("html").cast("long").alias("n_html"), pages.is_html(F.col("html")).alias("is_html"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', '', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '\s+', ' ', 'g'), '(?i)</?(a|abbr|acronym|b|big|cite|code|em|font|i|q|s|small|span|strike|strong|sub|sup|tt|u)(\s[^>]*)?/?>', '', 'g'), '<[^>]*>', chr(10), 'g') AS h FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(h, '&quot;', '"'), '&#39;', ''''), '&gt;', '>'), '&lt;', '<'), '&amp;', '&') AS h FROM b)
SELECT page_id, regexp_replace(regexp_replace(h, ' *\n[ \n]*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS plain FROM c""")
def scrubbed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I33, I35."""
    return read(spark, sf_dir, "pages").select("page_id", tx.scrub_html(F.col("html")).alias("plain"))


@query(rf"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, {_HOST} AS bare_host,
  regexp_replace(url, '#.*$', '') AS no_fragment, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment,
  lower(regexp_extract(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '\.([A-Za-z0-9]+)$', 1)) AS extension FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I56."""
    u = F.col("url")
    return read(spark, sf_dir, "pages").select(
        "page_id", urls.scheme(u).alias("scheme"), F.lower(urls.host(u)).alias("host"), F.lower(urls.host(u, True)).alias("bare_host"), urls.no_fragment(u).alias("no_fragment"),
        urls.path(u).alias("path"), urls.query(u).alias("query"), urls.fragment(u).alias("fragment"), urls.extension(u).alias("extension"),
    )


_ENDS = ("/index.html", "/./", "/a/../Index.SHTML?id={id}#top", "/x//y/./z/../;p=1?q={id}", "/b/INDEX.php/", "/default.html", "//deep/..//index.htm?", "")


@query(r"""WITH e AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN '/index.html' WHEN 1 THEN '/./' WHEN 2 THEN '/a/../Index.SHTML?id=' || page_id || '#top' WHEN 3 THEN '/x//y/./z/../;p=1?q=' || page_id
  WHEN 4 THEN '/b/INDEX.php/' WHEN 5 THEN '/default.html' WHEN 6 THEN '//deep/..//index.htm?' ELSE '' END AS e, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS bare FROM pages),
v AS (SELECT page_id, e, CASE WHEN page_id % 9 = 0 THEN 'FTP://www.' WHEN page_id % 9 = 1 THEN 'HTTPS://WWW.' ELSE 'http://www.' END || bare || CASE WHEN page_id % 2 = 0 AND NOT contains(bare, '/') THEN ':80' ELSE '' END || e AS v FROM e),
p AS (SELECT page_id, v, lower(regexp_extract(v, '^([A-Za-z]+):', 1)) AS scheme, regexp_replace(regexp_replace(lower(regexp_extract(v, '^[A-Za-z]+://([^/?#]*)', 1)), ':80$', ''), '^www\.', '') AS host,
  regexp_replace(regexp_extract(v, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path, regexp_extract(v, '\?([^#]*)', 1) AS asked, regexp_extract(v, '#(.*)$', 1) AS mark FROM v),
w AS (SELECT *, list_reduce(string_split(path, '/'), lambda done, x: CASE WHEN x IN ('', '.') THEN done WHEN x = '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || x END, '') AS walked FROM p),
n AS (SELECT *, CASE WHEN path = '' THEN '' ELSE CASE WHEN path LIKE '//%' AND path NOT LIKE '///%' THEN '/' ELSE '' END || CASE WHEN walked = '' THEN '/' ELSE walked END END AS normal FROM w),
k AS (SELECT *, scheme || '://' || host || regexp_replace(normal, '(?i)(index\.html|index\.htm|index\.shtml|index\.jsp|index\.php|/)$', '') || CASE WHEN asked <> '' THEN '?' || asked ELSE '' END AS whole FROM n)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(v, '^http://', ''), '^www\.', ''), '(?i)(index\.html|index\.htm|index\.shtml|index\.jsp|index\.php|/\.|/)+$', '') AS trimmed,
  CASE WHEN scheme = 'ftp' THEN v ELSE whole END AS canonical, md5(CASE WHEN scheme = 'ftp' THEN v ELSE whole || CASE WHEN mark <> '' THEN '#' || mark ELSE '' END END) AS mark FROM k""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries stay, .. steps are taken, index pages go, other schemes are left alone."""
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("page_id") % len(_ENDS) + 1).cast("int"))
    end = F.replace(end, F.lit("{id}"), F.col("page_id").cast("string"))
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    port = F.when((F.col("page_id") % 2 == 0) & ~F.contains(bare, F.lit("/")), ":80").otherwise("")
    opening = F.when(F.col("page_id") % 9 == 0, "FTP://www.").when(F.col("page_id") % 9 == 1, "HTTPS://WWW.").otherwise("http://www.")
    v = F.col("v")
    return read(spark, sf_dir, "pages").select("page_id", F.concat(opening, bare, port, end).alias("v")).select("page_id", urls.trim(v).alias("trimmed"), urls.canonical(v).alias("canonical"), urls.fingerprint(v).alias("mark"))


@query(rf"""WITH l AS (SELECT page_id, url, unnest({_HREFS}) AS href FROM pages)
SELECT page_id, href, CASE WHEN href LIKE 'http://%' THEN href WHEN href LIKE '/%' THEN 'http://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) || href ELSE url || href END AS bookmark,
  url_decode(regexp_extract(regexp_replace(href, '#.*$', ''), '([^/]*)/*$', 1)) AS tag FROM l""")
def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I50, I51, I61."""
    found = read(spark, sf_dir, "pages").select("page_id", "url", F.explode(pages.hrefs(F.col("html"))).alias("href"))
    return found.select("page_id", "href", urls.absolutise(F.col("href"), F.col("url")).alias("bookmark"), urls.tag_name(F.col("href")).alias("tag"))


_DOCS = rf"""a AS (SELECT page_id, url, {_TITLE} AS t, regexp_replace(html, '<.*?>', '', 'g') AS content, {_HOST} AS host, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang FROM pages),
docs AS (SELECT page_id, coalesce(nullif(t, ''), url) AS title, content, list_value(host) AS author, list_value(lang, regexp_extract(url, '^([a-z]+):', 1)) AS tags FROM a)"""


def _search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as search documents; host and language stand for authors and tags."""
    p = read(spark, sf_dir, "pages")
    h, u = F.col("html"), F.col("url")
    title = F.coalesce(F.nullif(pages.title(h), F.lit("")), u)
    return p.select("page_id", title.alias("title"), tx.strip_tags(h).alias("content"), F.array(F.lower(urls.host(u, True))).alias("author"), F.array(F.regexp_extract(h, 'lang="([a-z]+)"', 1), urls.scheme(u)).alias("tags"))


@query(f"""WITH {_DOCS} SELECT page_id, title, array_to_string(author, ',') AS author, array_to_string(tags, ',') AS tags FROM docs
WHERE contains(lower(title) || chr(1) || lower(content), 'the') AND contains(lower(title) || chr(1) || lower(content), 'and') ORDER BY title, page_id LIMIT 20""")
def news_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: search documents, all words required, sorted, first page. C4, G1, G2, I104."""
    found = search.matching(_search_documents(spark, sf_dir), "the and", ["title", "content"])
    return search.page(found, [F.col("title"), F.col("page_id")], 1, 20).select("page_id", "title", F.array_join("author", ",").alias("author"), F.array_join("tags", ",").alias("tags"))


@query(f"""WITH {_DOCS}, f AS (SELECT 'author' AS facet, unnest(author) AS value FROM docs UNION ALL SELECT 'tags', unnest(tags) FROM docs) SELECT facet, value, count(*) AS n FROM f GROUP BY ALL""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1."""
    return search.facet_counts(_search_documents(spark, sf_dir), ["author", "tags"])


@query(f"""WITH {_DOCS}, f AS (SELECT 'author' AS facet, unnest(author) AS value FROM docs UNION ALL SELECT 'tags', unnest(tags) FROM docs), n AS (SELECT facet, value, count(*) AS n FROM f GROUP BY ALL)
SELECT facet, value, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rank FROM n) WHERE rank <= 5""")
def facet_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10."""
    return search.facet_top(search.facet_counts(_search_documents(spark, sf_dir), ["author", "tags"]))


@query("""SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20""")
def search_second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, G2, G7."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return search.page(docs, [F.desc("n_chars"), F.col("doc_id")], 2, 20)


@query("""SELECT lang, count(*) AS n FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'token') GROUP BY lang""")
def search_result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4, E2."""
    return search.matching(read(spark, sf_dir, "documents"), "The token", ["text"]).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, w, len(w) AS l FROM t), tot AS (SELECT count(*) AS n, avg(l) AS a FROM s),
h AS (SELECT doc_id, l, q.term, len(list_filter(w, lambda x: x = q.term)) AS tf FROM s, (VALUES ('token'), ('thing'), ('was')) q(term)),
d AS (SELECT term, count(*) AS df FROM h WHERE tf > 0 GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / a)))), 6) AS score FROM h JOIN d USING (term), tot WHERE tf > 0 GROUP BY doc_id""")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5, by BM25."""
    return search.bm25(read(spark, sf_dir, "documents"), "thing token was", "doc_id", "text").select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_DOCS} SELECT page_id, title, strftime(TIMESTAMP '{NOW}', '%Y-%m-%d') AS day FROM docs""")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I104, B2."""
    p = read(spark, sf_dir, "pages")
    found = p.select("page_id", F.col("url").alias("bookmark"), pages.title(F.col("html")).alias("entry_title"), F.col("html").alias("entry_content"), F.lit(None).cast("string").alias("entry_summary"), F.lit(None).cast("timestamp").alias("updated"), F.lit(None).cast("timestamp").alias("published"))
    return search.documents(found, F.lit(NOW).cast("timestamp")).select("page_id", "title", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query(rf"""WITH l AS (SELECT page_id, url, unnest({_HREFS}) AS href FROM pages), c AS (SELECT page_id, href, CASE WHEN right(lower(href), 4) IN ('.rss', '.rdf', '.xml') THEN 1
  WHEN regexp_matches(lower(regexp_extract(href, '([^/]*)$', 1)), 'rss|rdf|xml') AND NOT regexp_matches(lower(regexp_extract(href, '([^/]*)$', 1)), '^\.*[^.].*\.(gif|png|jpg|jpeg|html|htm|shtml|gz|tgz|zip|txt|pdf|doc|docx|swf|xls|xlsx|ppt|pptx)$') THEN 2 ELSE 3 END AS stage FROM l)
SELECT DISTINCT page_id, href, stage FROM c QUALIFY stage = min(stage) OVER (PARTITION BY page_id)""")
def feed_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a page's links those of the first stage that has any."""
    found = read(spark, sf_dir, "pages").select("page_id", F.explode(pages.hrefs(F.col("html"))).alias("href"))
    stage = F.when(urls.is_feed_link(F.col("href")), 1).when(urls.is_xml_related(F.col("href")), 2).otherwise(3)
    return graph.discovery_ladder(found.withColumn("stage", stage), "page_id")


@query(rf"""WITH a AS (SELECT url, {_HOST} AS host FROM pages WHERE url LIKE 'https:%') SELECT page_id, url FROM pages WHERE {_HOST} NOT IN (SELECT host FROM a)""")
def not_crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of hosts of which no page was crawled over https."""
    p = read(spark, sf_dir, "pages").select("page_id", "url", F.lower(urls.host(F.col("url"), True)).alias("host"))
    return store.not_crawled(p, p.filter("url like 'https:%'"), "host").select("page_id", "url")


@query("""SELECT 'x=' || CAST(page_id AS VARCHAR) || CASE WHEN page_id % 2 = 0 THEN '&url=' || url_encode(url) ELSE '' END AS q, page_id FROM pages""")
def query_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: parameters that are null are left out."""
    return read(spark, sf_dir, "pages").select(urls.query_string({"x": F.col("page_id").cast("string"), "url": F.when(F.col("page_id") % 2 == 0, F.col("url"))}).alias("q"), "page_id")


@query(r"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, url FROM p WHERE NOT (host LIKE '%.org' AND starts_with(path, '/en')) OR (host LIKE '%.org' AND starts_with(path, '/en/6'))""")
def allowed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts in .org forbid /en but for /en/6."""
    from inkstream.operators import robots

    p = read(spark, sf_dir, "pages").select("page_id", "url")
    hosts = p.select(F.lower(urls.host(F.col("url"))).alias("host")).distinct().filter(F.col("host").endswith(".org"))
    rules = robots.read_rules(hosts.withColumn("text", F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /en # but\nAllow: /en/6\n")), "text")
    return robots.may_fetch(p, rules)
