"""The article store: due pages, absolute bookmarks, get-or-create, upsert, bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions import dates, urls
from inkstream.operators.runs import first_wins

SCHEMAS = {
    "crawl_site": "url STRING, name STRING",
    "feed_page": "id BIGINT, url STRING, site_id BIGINT, updated_at TIMESTAMP, refresh_minutes INT, refresh_at TIMESTAMP",
    "article": "bookmark STRING, entry_title STRING, entry_content STRING, entry_summary STRING, updated TIMESTAMP, published TIMESTAMP, tags ARRAY<STRING>",
    "article_entity": "article_id BIGINT, entity_type STRING, entity_id BIGINT",
    "feed_page_article": "feed_page_id BIGINT, article_id BIGINT",
    "author": "url STRING",
    "name": "fn STRING",
    "author_name": "author_url STRING, fn STRING, articles ARRAY<STRING>",
    "worked_on": "author_url STRING, bookmark STRING, role STRING",
    "principles": "url STRING, articles ARRAY<STRING>",
    "revision": "bookmark STRING, source STRING, entry_title STRING, entry_content STRING, entry_summary STRING",
    "person": "uri STRING, name STRING, role STRING, data STRING, source STRING",
    "organisation": "uri STRING, name STRING, nationality STRING, type STRING, data STRING, source STRING",
    "place": "uri STRING, name STRING, data STRING, source STRING",
}


def by_key(df: DataFrame, **keys: object) -> DataFrame:
    """Rows whose columns have the given values; null means null. Plain equality, which the scan prunes by."""
    for name, value in keys.items():
        df = df.filter(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return df


def without_children(parents: DataFrame, children: DataFrame, key: str, reference: str) -> DataFrame:
    """Parents that no child refers to, such as sites without feed pages."""
    return parents.join(children.select(F.col(reference).alias(key)), key, "left_anti")


def due_pages(pages: DataFrame, now: Column) -> DataFrame:
    """Pages whose refresh time has passed; a page without one is not due."""
    return pages.filter(F.col("refresh_at") < now)


def schedule(pages: DataFrame, now: Column) -> DataFrame:
    """Pages as fetched now, with the time of their next refresh."""
    return pages.withColumns({"updated_at": now, "refresh_at": dates.next_refresh(now, F.col("refresh_minutes"))})


def not_crawled(pages: DataFrame, crawled: DataFrame, key: str = "url") -> DataFrame:
    return pages.join(crawled.select(key).distinct(), key, "left_anti")


def get_or_create(found: DataFrame, stored: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Stored rows, and of the others the first of each key."""
    new = first_wins(found, keys, order).join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(new.select(*stored.columns))


def upsert(found: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Found rows in place of stored ones of the same keys; what a found row leaves null stays as stored.

    One full outer join on the keys; for repeated runs the result is the same.
    """
    rest = [c for c in stored.columns if c not in keys]
    a = found.select(*keys, *[F.col(c).alias(f"_{c}") for c in rest])
    return stored.join(a, keys, "full_outer").select(*keys, *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in rest])


def articles(entries: DataFrame, now: Column | None = None) -> DataFrame:
    """Entries (page_url, bookmark, entry_title, entry_content, entry_summary, updated, published, tag) as articles;
    times that are missing are now."""
    tags = F.split(F.lower(F.array_join(F.transform("tag", lambda t: t["name"]), ",")), ",")
    return entries.select(
        urls.absolutise(F.col("bookmark"), F.col("page_url")).alias("bookmark"), "entry_title", "entry_content", "entry_summary",
        dates.to_utc(F.col("updated"), now).alias("updated"), dates.to_utc(F.col("published"), now).alias("published"),
        F.when(F.size("tag") > 0, tags).otherwise(F.array().cast("array<string>")).alias("tags"),
    )


def author_names(worked: DataFrame) -> DataFrame:
    """How many articles each name of an author stands under."""
    return worked.groupBy("author_url", "fn").agg(F.countDistinct("bookmark").alias("n_articles"))


def tag_text(df: DataFrame, keys: list[str], tag: str, order: str) -> DataFrame:
    """Tags of each key as one lower-case text, in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tag).alias("t"))))
    return df.groupBy(*keys).agg(F.lower(F.array_join(F.transform(listed, lambda x: x["t"]), ",")).alias("tags"))


def analysis_text(title: Column, content: Column) -> Column:
    return F.concat_ws(" ", title, content)


def serialized(df: DataFrame, model: str, key: str) -> DataFrame:
    """Rows as JSON objects of pk, model and fields, as a list of records is handed out; null fields are written as null."""
    fields = F.struct(*[F.col(c) for c in df.columns if c != key])
    return df.select(key, F.to_json(F.struct(F.col(key).alias("pk"), F.lit(model).alias("model"), fields.alias("fields")), {"ignoreNullFields": "false"}).alias("json"))


def detail_json(df: DataFrame, model: str, key: str, **wanted: object) -> DataFrame:
    """One row: the records of the given key or slug as a JSON list, null if there is none. Records of one key are few."""
    rows = serialized(by_key(df, **wanted), model, key).agg(F.sort_array(F.collect_list("json")).alias("all"))
    return rows.select(F.when(F.size("all") > 0, F.concat(F.lit("["), F.array_join("all", ","), F.lit("]"))).alias("json"))
