"""Web pages as records, by patterns only: title, headings, links, images, feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions import text as tx



def title(html: Column) -> Column:
    """Text of the title element, white space collapsed; empty if there is none."""
    return tx.collapse_spaces(tx.strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def heading(html: Column, level: int) -> Column:
    """Text of the first heading of a level; empty if there is none."""
    return tx.collapse_spaces(tx.strip_tags(F.regexp_extract(html, f"(?is)<h{level}[^>]*>(.*?)</h{level}>", 1)))


def document_title(html: Column) -> Column:
    """The first heading that is not empty, in order of level, else the page's title."""
    return F.coalesce(*[F.nullif(heading(html, n), F.lit("")) for n in range(1, 7)], title(html))


def tags(html: Column, name: str) -> Column:
    """The start tags of an element in order, those within comments left out. A > within quotes does not end a tag."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|$)", "")
    return F.regexp_extract_all(bare, F.lit(rf"""(?is)(<{name}(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+>)"""), F.lit(1))


def attribute(tag: Column, name: str) -> Column:
    """The first attribute of that very name (not of one that ends in it, nor within another's value), quoted or bare, with
    entities decoded; empty if there is none."""
    found = F.regexp_extract(tag, rf"""(?is)^<[a-z][^\s/>]*+(?:(?:\s|/)*+(?!{name}\s*+=)(?:[^\s=>"'/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+|["'=]))*+(?:\s|/)*+{name}\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", 1)
    return tx.unescape_html(F.regexp_replace(found, "^[\"']|[\"']$", ""))


def has_token(value: Column, token: str) -> Column:
    """Whether blank-separated words hold a token, without regard to case."""
    return F.array_contains(F.split(F.lower(value), r"\s+"), token)


def attributes(html: Column, name: str, attr: str) -> Column:
    """An attribute of all start tags of an element that have it, in order."""
    return F.filter(F.transform(tags(html, name), lambda t: attribute(t, attr)), lambda v: v != "")


def hrefs(html: Column) -> Column:
    """Targets of all links in order."""
    return attributes(html, "a", "href")


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, href): each link of a page with its place from 0."""
    return pages.select(key, F.posexplode(hrefs(F.col(html))).alias("pos", "href"))


def distinct_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, href): links without fragments and repeats, numbered as they come first. No shuffle."""
    bare = F.filter(F.transform(hrefs(F.col(html)), lambda h: F.regexp_replace(h, "#.*$", "")), lambda h: h != "")
    return pages.select(key, F.posexplode(F.array_distinct(bare)).alias("pos", "href"))


def images(pages: DataFrame, key: str = "page_id", html: str = "html", least: int = 16) -> DataFrame:
    """(key, pos, src): distinct images, without those that say they are narrower or lower than `least`."""
    size = lambda t, side: F.regexp_extract(attribute(t, side), r"^\s*(\d+)", 1).try_cast("int")
    big = F.filter(tags(F.col(html), "img"), lambda t: (F.coalesce(size(t, "width"), F.lit(least)) >= least) & (F.coalesce(size(t, "height"), F.lit(least)) >= least))
    found = F.array_distinct(F.filter(F.transform(big, lambda t: attribute(t, "src")), lambda s: s != ""))
    return pages.select(key, F.posexplode(found).alias("pos", "src"))


def feeds(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, href): feeds that a page's link elements announce."""
    told = F.filter(tags(F.col(html), "link"), lambda t: has_token(attribute(t, "rel"), "alternate") & attribute(t, "type").rlike(r"(?i)application/(rss|atom|rdf)\+xml"))
    links = F.filter(F.transform(told, lambda t: attribute(t, "href")), lambda h: h != "")
    return pages.select(key, F.explode(F.array_distinct(links)).alias("href"))


def base_href(html: Column) -> Column:
    return F.coalesce(F.get(attributes(html, "base", "href"), F.lit(0)), F.lit(""))


def is_html(raw: Column) -> Column:
    head = F.lower(F.substring(raw, 1, 256))
    return F.contains(head, F.lit("<html")) | F.contains(head, F.lit("<!doctype html"))


def is_rss(raw: Column) -> Column:
    """Whether a text's opening, of 2,024 characters, has a feed's root and is no HTML."""
    head = F.lower(F.substring(raw, 1, 2024))
    return ~F.contains(head, F.lit("<html")) & head.rlike("<rss|<rdf|<feed")


def is_opml(raw: Column) -> Column:
    low = F.lower(raw)
    return ~F.contains(low, F.lit("<html")) & F.contains(low, F.lit("<opml"))


def ranked_feeds(feeds: DataFrame, rank: str = "headlines_rank") -> DataFrame:
    """Feeds by falling rank; equal ones by address."""
    return feeds.orderBy(F.desc(rank), "href")


#: What goes from titles of feeds, by host (fixed values).
TITLE_RULES = {"upcoming.yahoo.com": r"^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d+, \d\d\d\d: *", "twitter.com": r"^.*?: *"}


def scrub_title(uri: Column, title: Column, rules: dict[str, str] | None = None) -> Column:
    """The title without what the rule of its host takes away; of several rules that of the longest host counts. A rule
    holds for hosts below its own, not for addresses with a port."""
    host = F.lower(F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    out = title
    for name, pattern in sorted((TITLE_RULES if rules is None else rules).items(), key=lambda r: len(r[0])):
        out = F.when((host == name) | host.endswith(f".{name}"), F.regexp_replace(title, pattern, "")).otherwise(out)
    return out


def value_of(entry: Column, key: str, as_text: bool = False) -> Column:
    """A value of a feed's entry in JSON: of lists the first, of records their value, without entities (or, as text,
    without tags as well) if it is HTML; null if there is none."""
    first = lambda c, k: F.coalesce(F.get_json_object(c, f"$['{k}'][0]"), F.get_json_object(c, f"$['{k}']"))
    raw = first(entry, key)
    inner = first(raw, "value")
    plain = tx.strip_tags(inner) if as_text else inner
    shown = F.when(F.get_json_object(raw, "$.type") == "text/html", tx.unescape_html(plain)).otherwise(inner)
    return F.nullif(F.when(raw.startswith("{"), shown).otherwise(raw), F.lit(""))
