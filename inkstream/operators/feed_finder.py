"""Feeds of pages, by the first of several stages that finds any: the page itself, its link elements, hints, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions import urls
from inkstream.operators import graph, pages

#: Types by which link elements announce feeds; a type may go on (fixed values).
FEED_TYPES = ("application/rss", "application/atom", "application/rdf", "application/xml", "text/xml", "application/x.atom")


def _links(tags: Column, url: Column) -> Column:
    """Where tags lead: addresses without fragments, each once. Steps bind what later ones use more than once."""
    told = F.filter(F.transform(tags, lambda t: pages.attribute(t, "href")), lambda h: h != "")
    return F.array_distinct(F.transform(F.transform(told, lambda h: urls.join(url, h)), lambda x: F.regexp_replace(x, "#.*$", "")))


def announced(html: Column, url: Column) -> Column:
    """Addresses of the feeds that link elements announce, in order."""
    types = "^(" + "|".join(x.replace(".", r"\.") for x in FEED_TYPES) + ")"
    return _links(F.filter(pages.tags(html, "link"), lambda t: pages.attribute(t, "rel").isin("alternate", "service.feed") & pages.attribute(t, "type").rlike(types)), url)


def linked(html: Column, url: Column) -> Column:
    """Addresses of all links of a page."""
    return _links(pages.tags(html, "a"), url)


def start_link(html: Column, url: Column) -> Column:
    """Where the site begins: its start, else its home link, else what the address gives away; null if nothing does."""
    of = lambda rel: F.get(_links(F.filter(pages.tags(html, "link"), lambda t: pages.attribute(t, "rel") == rel), url), F.lit(0))
    return F.coalesce(of("start"), of("home"), urls.home(url))


def stages(html: Column, url: Column, links: Column, local: Column, hints: tuple[str, ...] = ()) -> Column:
    """An array of (stage, links), from the surest stage on, of a page's links and those below it. Pages that are feeds
    have themselves; outlines have nothing."""
    matching = lambda among, hint: F.filter(among, lambda x: x.rlike(f"(?i){hint}"))
    hinted = lambda among: F.array_distinct(F.flatten(F.array(*[matching(among, h) for h in hints]))) if hints else F.array().cast("array<string>")
    found = (
        announced(html, url), hinted(local), hinted(links), F.filter(links, urls.is_burner_link), F.filter(local, urls.is_feed_link), F.filter(local, urls.is_xml_related), F.filter(links, urls.is_feed_link),
    )
    listed = F.array(*[F.struct(F.lit(n).alias("stage"), x.alias("links")) for n, x in enumerate(found, 2)])
    itself = F.array(F.struct(F.lit(1).alias("stage"), F.array(url).alias("links")))
    return F.when(pages.is_rss(html), itself).when(~pages.is_opml(html), listed)


def find(df: DataFrame, key: str, url: str = "url", html: str = "html", hints: tuple[str, ...] = (), saved: DataFrame | None = None) -> DataFrame:
    """(key, stage, href): each page's feeds by its first stage that has any.

    Without `saved`, the first stage is chosen within the row: one pass, no shuffle. With it, a table (url, html) of saved
    answers with one row for each url, links count only if what was saved for them is a feed (but for hints), and where a
    page's start link was saved and announces feeds, these take the place of its own; addresses are joined by shuffling.
    """
    plain = df.select(F.col(key), F.col(url).alias("_url"), F.col(html).alias("_html"))
    told = plain.withColumn("_links", linked(F.col("_html"), F.col("_url"))).withColumn("_local", F.filter("_links", lambda x: urls.is_local_link(x, F.col("_url"))))
    staged = stages(F.col("_html"), F.col("_url"), F.col("_links"), F.col("_local"), hints)
    if saved is None:
        first = F.get(F.filter(staged, lambda s: F.size(s["links"]) > 0), F.lit(0))
        return told.select(key, first.alias("_s")).select(key, "_s.stage", F.explode("_s.links").alias("href"))
    starts = saved.select(F.col("url").alias("_start"), announced(F.col("html"), F.col("url")).alias("_more")).filter(F.size("_more") > 0)
    each = told.select(key, start_link(F.col("_html"), F.col("_url")).alias("_start"), staged.alias("_stages")).join(starts, "_start", "left")
    flat = each.select(key, "_more", F.explode("_stages").alias("_s")).select(key, "_s.stage", F.when((F.col("_s.stage") == 2) & F.col("_more").isNotNull(), F.col("_more")).otherwise(F.col("_s.links")).alias("_links"))
    links = flat.select(key, "stage", F.explode("_links").alias("href"))
    known = saved.filter(pages.is_rss(F.col("html"))).select(F.col("url").alias("_feed"))
    sure = F.col("stage").isin(1, 3, 4)
    checked = links.join(known, F.col("href") == F.col("_feed"), "left").filter(sure | F.col("_feed").isNotNull()).drop("_feed")
    return graph.discovery_ladder(checked, key)
