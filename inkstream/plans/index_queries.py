"""Queries over what is kept beside the articles: the inverted index, facet bitmaps, saved responses, versions, mentions of known names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.operators import bitmaps, inverted, loader, mentions, versioned
from inkstream.plans.base import NOW, query, read
from inkstream.shared import shared_dir
from inkstream.sources import responses

#: After an index of all documents: every tenth is changed to its source's name before its text, every tenth is deleted.
_CORPUS = "corpus AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'renamed token ' || coalesce(source, '') || ' ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE doc_id % 10 <> 7)"


def _scored(words: list[str]) -> str:
    listed = ", ".join(f"('{w}')" for w in words)
    return rf"""{_CORPUS}, t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM corpus),
s AS (SELECT doc_id, w, len(w) AS l FROM t), tot AS (SELECT count(*) AS n, avg(l) AS a FROM s),
h AS (SELECT doc_id, l, q.term, len(list_filter(w, lambda x: x = q.term)) AS tf FROM s, (VALUES {listed}) q(term)),
d AS (SELECT term, count(*) AS df FROM h WHERE tf > 0 GROUP BY term),
scored AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / a)))), 6) AS score FROM h JOIN d USING (term), tot WHERE tf > 0 GROUP BY doc_id)"""


def _index(spark: SparkSession, sf_dir: str) -> str:
    path = f"{shared_dir(spark)}/inkstream/index-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    inverted.append(path, docs, "doc_id", "text")
    renamed = F.concat(F.lit("renamed token "), F.coalesce("source", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))
    inverted.append(path, docs.filter("doc_id % 10 = 3").withColumn("text", renamed), "doc_id", "text", docs.filter("doc_id % 10 = 7").select("doc_id"))
    return path


@query(f"WITH {_scored(['renamed', 'thing', 'token', 'was'])} SELECT * FROM scored")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from the index after changes and deletions, by the postings of four words."""
    return inverted.ranked(spark, _index(spark, sf_dir), "thing token was renamed", "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_scored(['thing', 'token'])} SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 25")
def best_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents after a merge, without opening cells that cannot hold one."""
    path = _index(spark, sf_dir)
    inverted.merge(path, spark)
    return inverted.top(spark, path, "thing token", 25, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("""WITH f AS (SELECT doc_id, 'lang' AS facet, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents UNION ALL SELECT doc_id, 'size', CAST(n_chars // 1000 AS VARCHAR) FROM documents),
r AS (SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND contains(text, 'the')) SELECT facet, value, count(*) AS n FROM f JOIN r USING (doc_id) WHERE value IS NOT NULL GROUP BY ALL""")
def facets_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet counts within a filter by facet and a text search, from bitmaps alone."""
    docs = read(spark, sf_dir, "documents")
    faceted = docs.select("doc_id", F.array("lang").alias("lang"), F.array("source").alias("source"), F.array(F.floor(F.col("n_chars") / 1000).cast("string")).alias("size"))
    kept = bitmaps.facet_bitmaps(faceted, "doc_id", ["lang", "source", "size"])
    found = bitmaps.result_bitmaps(docs.filter(F.contains("text", F.lit("the"))), "doc_id")
    return bitmaps.counts_within(kept, bitmaps.both(bitmaps.having(kept, "lang", ["en", "de"]), found))


@query("""WITH p AS (SELECT page_id, url, html, CASE WHEN page_id % 3 <> 0 OR page_id % 4 = 3 THEN 'none' WHEN page_id % 4 = 0 THEN 'fresh' ELSE 'check' END AS state FROM pages),
o AS (SELECT *, CASE WHEN state = 'fresh' THEN 'fresh' WHEN page_id % 5 = 0 THEN 'loaded' WHEN state = 'check' THEN CASE WHEN page_id % 5 = 1 THEN 'unchanged' ELSE 'kept' END
  WHEN page_id % 5 IN (1, 3) THEN 'loaded' WHEN page_id % 5 = 2 THEN 'not found' ELSE 'failed' END AS outcome FROM p)
SELECT page_id, outcome, CAST(CASE outcome WHEN 'not found' THEN 404 WHEN 'failed' THEN 500 ELSE 200 END AS INTEGER) AS status,
  CAST(CASE WHEN outcome = 'loaded' THEN strlen(html) WHEN outcome IN ('fresh', 'unchanged', 'kept') THEN strlen(url) END AS INTEGER) AS n_bytes,
  CAST(CASE WHEN outcome = 'fresh' THEN 0 WHEN state = 'check' OR page_id % 5 IN (0, 2) THEN 1 ELSE 2 END AS INTEGER) AS attempts, outcome IN ('loaded', 'unchanged', 'not found') AS saved FROM o""")
def loaded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the loader's rules, from a cache and from responses saved by host and read back."""
    path = f"{shared_dir(spark)}/inkstream/responses-{uuid.uuid4().hex}"
    p = read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("address"), F.concat("url", F.lit("#"), "page_id").alias("url"), "html")
    k, now = F.col("page_id"), F.lit(NOW).cast("timestamp")
    said = [F.when(k % 5 == 0, 200).when(k % 5 == 1, 304).when(k % 5 == 2, 404).when(k % 5 == 3, 500).otherwise(503), F.when(k % 5 == 4, 500).otherwise(200)]
    for attempt, status in enumerate(said):
        body = F.when(status == 200, F.encode("html", "UTF-8"))
        rows = p.select("url", status.alias("status"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("modified"), body.alias("body"), now.alias("saved_at"), F.concat(F.lit("host"), k % 5, F.lit(".example")).alias("host"))
        responses.save(rows, path, attempt)
    answers = responses.read(spark, path).select("url", F.col("batch").alias("attempt"), "status", "etag", "modified", "body")
    age = F.when(k % 4 == 0, 100).when(k % 4 == 1, 400).when(k % 4 == 2, 4000).otherwise(31 * 86400)
    cache = p.filter(k % 3 == 0).select("url", F.lit(200).alias("status"), F.lit("e").alias("etag"), F.lit(None).cast("string").alias("modified"), F.encode("address", "UTF-8").alias("body"), F.timestamp_seconds(F.unix_timestamp(now) - age).alias("saved_at"))
    out = loader.load(p.select("url", now.alias("at"), "page_id"), cache, answers)
    return out.join(p.select("url", "page_id"), "url").select("page_id", "outcome", "status", F.length("body").alias("n_bytes"), "attempts", F.col("saved_at").isNotNull().alias("saved"))


@query("""WITH c AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer), t(n, day) AS (VALUES (1, TIMESTAMP '2024-01-01'), (2, TIMESTAMP '2024-01-02'), (3, TIMESTAMP '2024-01-03'), (4, TIMESTAMP '2024-01-04')),
v AS (SELECT k, name, segment, 1 AS f, CASE WHEN k % 3 = 0 THEN 2 WHEN k % 7 = 0 THEN 4 END AS u FROM c UNION ALL SELECT k, name, 'two', 2, CASE WHEN k % 5 = 0 THEN 3 WHEN k % 7 = 0 THEN 4 END FROM c WHERE k % 3 = 0
  UNION ALL SELECT k, name, segment, 3, CASE WHEN k % 7 = 0 THEN 4 END FROM c WHERE k % 15 = 0)
SELECT k, name, segment, a.day AS valid_from, b.day AS valid_to FROM v JOIN t a ON a.n = f LEFT JOIN t b ON b.n = u""")
def article_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, D5, revisions: four commits, one of them twice; what changed is closed, what did not is left alone."""
    path = f"{shared_dir(spark)}/inkstream/versions-{uuid.uuid4().hex}"
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    at = lambda day: F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")
    two = c.filter("k % 3 = 0").select("k", F.lit(None).cast("string").alias("name"), F.lit("two").alias("segment"))
    for day, rows, name in ((1, c, "first"), (2, two, "second"), (9, two, "second"), (3, c.filter("k % 5 = 0"), "third")):
        versioned.merge(path, rows, ["k"], at(day), commit=name)
    versioned.merge(path, c.limit(0), ["k"], at(4), commit="fourth", gone=c.filter("k % 7 = 0").select("k"))
    return versioned.history(spark, path, c.schema)


@query(r"""WITH g AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{7,}')) AS name FROM documents WHERE doc_id % 50 = 0),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS name, unnest(generate_series(1, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')))) AS pos FROM documents),
m AS (SELECT doc_id, count(*) AS n, md5(string_agg(name, ',' ORDER BY pos)) AS names FROM w JOIN g USING (name) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_mentions, coalesce(names, md5('')) AS names_md5, true AS in_place FROM documents LEFT JOIN m USING (doc_id)""")
def found_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9, I102: mentions of known names in whole texts; the names are the long words of some of the documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    names = docs.filter("doc_id % 50 = 0").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{7,})"), F.lit(1))).alias("name")).distinct().withColumn("kind", F.lit("word"))
    found = mentions.find_mentions(docs, names, "doc_id", "text").join(docs, "doc_id")
    listed = F.array_join(F.transform("mentions", lambda m: m["name"]), ",")
    placed = F.forall("mentions", lambda m: F.substring(F.col("text"), m["offset"] + 1, m["length"]) == m["name"])
    return found.select("doc_id", F.size("mentions").cast("long").alias("n_mentions"), F.md5(listed).alias("names_md5"), placed.alias("in_place"))
