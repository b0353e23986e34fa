"""Search documents, contains-all and ranked search, facets, sorts and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkstream.functions import text as tx

#: Multi-valued facets of a search document.
FACETS = ("author", "tags", "people", "organisations", "places")
BM25_K1, BM25_B = 1.2, 0.75


def documents(articles: DataFrame, now: Column, transforms: dict[str, Column] | None = None) -> DataFrame:
    """Search fields: date (updated, published, now), title (or bookmark), content (or summary) without tags; transforms
    add fields, or stand in place of these."""
    body = F.coalesce(F.nullif(F.col("entry_content"), F.lit("")), F.nullif(F.col("entry_summary"), F.lit("")), F.lit(""))
    return articles.withColumns(
        {
            "date": F.coalesce("updated", "published", now),
            "title": F.coalesce(F.nullif(F.col("entry_title"), F.lit("")), F.col("bookmark")),
            "content": tx.strip_tags(body),
            **(transforms or {}),
        }
    )


def with_facets(docs: DataFrame, key: str, authors: DataFrame, mentions: DataFrame, tags: str = "tags") -> DataFrame:
    """docs with the five facets: author from (key, name), people, organisations and places from (key, kind, name), tags
    from comma-joined text. Both sides are combined before they are shuffled by the key; names of one document are a set."""
    names = F.sort_array(F.collect_set("name"))
    kinds = {"people": "person", "organisations": "organisation", "places": "place"}
    by_kind = mentions.groupBy(key).agg(*[F.sort_array(F.collect_set(F.when(F.col("kind") == v, F.col("name")))).alias(k) for k, v in kinds.items()])
    joined = docs.join(authors.groupBy(key).agg(names.alias("author")), key, "left").join(by_kind, key, "left")
    none = F.array().cast("array<string>")
    return joined.withColumns({k: F.coalesce(k, none) for k in ("author", *kinds)} | {"tags": F.split(F.coalesce(F.col(tags), F.lit("")), ",")})


def matching(docs: DataFrame, query: str, fields: list[str]) -> DataFrame:
    return docs.filter(tx.contains_all(F.lit(query), *[F.col(f) for f in fields]))


def facet_counts(docs: DataFrame, fields: list[str] | tuple[str, ...] = FACETS) -> DataFrame:
    """(facet, value, n) of array fields: one pass and one shuffle for all of them."""
    each = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("all")) for f in fields])
    flat = docs.select(F.explode(each).alias("f")).select("f.facet", F.explode("f.all").alias("value"))
    return flat.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def facet_top(counts: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent values of each facet; ties by value."""
    w = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def page(docs: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """A page of sorted results; the engine takes the top rows only, from each partition first."""
    return docs.orderBy(*order).offset((number - 1) * size).limit(size)


def page_links(total: int, number: int, size: int) -> dict[str, int | None]:
    pages = max(1, -(-total // size))
    return {"pages": pages, "previous": number - 1 if number > 1 else None, "next": number + 1 if number < pages else None}


def query_words(query: str) -> list[str]:
    """The distinct words of a query, sorted."""
    return sorted({w for w in query.lower().split() if w})


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def bm25(docs: DataFrame, query: str, key: str, field: str) -> DataFrame:
    """(key, score) of documents with any word of the query; an empty query matches all documents, at nought.

    Scans the documents: `inverted` keeps an index. Only the query's words leave a document, so the shuffle carries a few
    rows for each match; corpus totals are one aggregate joined as a single row.
    """
    words = query_words(query)
    if not words:
        return docs.select(F.col(key), F.lit(0.0).alias("score"))
    sized = docs.select(F.col(key), words_of(F.col(field)).alias("w")).select(key, F.size("w").alias("len"), "w")
    totals = sized.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    each = F.array(*[F.struct(F.lit(w).alias("term"), (F.size("w") - F.size(F.array_remove("w", w))).alias("tf")) for w in words])
    hits = sized.select(key, "len", F.explode(each).alias("t")).select(key, "len", "t.term", "t.tf").filter("tf > 0")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.col("avg_len")))
    weighed = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals))  # a row for each query word; one row
    return weighed.groupBy(key).agg(F.sum(idf * tf).alias("score"))


def result_json(docs: DataFrame, facets: DataFrame, total: int, number: int, size: int) -> DataFrame:
    """One row: the page of results with facets and page links as JSON text; both inputs are pages, so small."""
    items = docs.agg(F.to_json(F.collect_list(F.struct(*docs.columns))).alias("articles"))
    sides = facets.groupBy("facet").agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("values")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("facet", "values")))).alias("facets"))
    links = F.to_json(F.create_map(*[x for k, v in page_links(total, number, size).items() for x in (F.lit(k), F.lit(v).cast("int"))]))
    return items.crossJoin(sides).select("articles", "facets", links.alias("pages"))
