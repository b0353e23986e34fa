"""One step of the crawl over saved pages: their entries become articles that the store lacks, with authors and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions import dates, records, urls
from inkstream.operators import pages as markup
from inkstream.operators import store
from inkstream.sources import microformats


def entries(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page_url, pos, fields, children): a page's entries and its news entries side by side, by position; where both
    have a field that of the news entry stands. One parse, no join."""
    found = microformats.microformats(pages.select(F.col(url).alias("page_url"), F.col(html).alias("html")), "html", ("hatom", "hnews"))
    of = lambda name: F.filter("records", lambda r: r["format"] == name)
    no_fields, no_children = F.create_map().cast("map<string,string>"), F.array().cast("array<struct<name:string,fields:map<string,string>>>")

    def beside(a: Column, b: Column) -> Column:
        fields = records.united(F.coalesce(b["fields"], no_fields), F.coalesce(a["fields"], no_fields))
        children = F.concat(F.coalesce(a["children"], no_children), F.coalesce(b["children"], no_children))
        return F.struct(fields.alias("fields"), children.alias("children"))

    pairs = F.zip_with(of("hatom"), of("hnews"), beside)
    return found.select("page_url", F.posexplode(pairs).alias("pos", "e")).select("page_url", "pos", "e.fields", "e.children")


def articles(found: DataFrame, now: Column) -> DataFrame:
    """Entries as articles: absolute bookmarks, times in UTC (now where there is none), lower-case tags, the author."""
    field = lambda name: F.try_element_at("fields", F.lit(name))
    children = lambda name: F.filter("children", lambda c: c["name"] == name)
    tags = F.transform(children("tag"), lambda c: F.lower(F.try_element_at(c["fields"], F.lit("name"))))
    return found.select(
        "page_url", "pos", urls.absolutise(field("bookmark"), F.col("page_url")).alias("bookmark"),
        field("entry-title").alias("title"), field("entry-content").alias("content"), field("entry-summary").alias("summary"),
        dates.to_utc(field("updated"), now).alias("updated"), dates.to_utc(field("published"), now).alias("published"),
        F.array_join(tags, ",").alias("tags"), F.try_element_at(F.get(children("author"), F.lit(0))["fields"], F.lit("fn")).alias("author"),
        field("dateline").alias("dateline"),
    )


def crawl(pages: DataFrame, stored: DataFrame, now: Column, url: str = "url", html: str = "html") -> DataFrame:
    """The store's articles, and of those the pages have besides the first of each bookmark (by page, then position)."""
    return store.get_or_create(articles(entries(pages, url, html), now), stored, ["bookmark"], ["page_url", "pos"])


def next_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, next): the pages that each page names as the next by links (`a`) with that relation, absolute as the crawl
    makes links, each once; pages without one are left out."""
    told = F.filter(markup.tags(F.col(html), "a"), lambda t: markup.has_token(markup.attribute(t, "rel"), "next"))
    links = F.array_distinct(F.filter(F.transform(told, lambda t: markup.attribute(t, "href")), lambda h: h != ""))
    found = pages.select(F.col(url).alias("url"), F.explode(links).alias("href"))
    return found.select("url", urls.absolutise(F.col("href"), F.col("url")).alias("next")).distinct()
