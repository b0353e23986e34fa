"""XML as rows in the JVM: texts by from_xml with a stated schema, files element by element, so that one large feed
is split over tasks. Namespace prefixes go; repeats are arrays; what the schema does not name is not read. Texts that
are no XML give null. For texts without a stated schema there is `objects`, which reads them in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstream.functions import dates

_OPTIONS = {"ignoreNamespace": "true", "attributePrefix": "@", "valueTag": "@@"}
#: An entry of an RSS feed. Elements of Dublin Core and of content modules are known by their names alone.
ITEM = "title string, link string, description string, encoded string, guid string, pubDate string, date string, author string, creator string, category array<string>"
#: Feeds of version 2.0 and its forerunners, with items in the channel, and those of 1.0 with items beside it.
RSS = f"channel struct<title string, link string, description string, language string, item array<struct<{ITEM}>>>, item array<struct<{ITEM}>>"


def parse(text: Column, schema: str | T.StructType) -> Column:
    """The fields of a text's root element; null if it is no XML."""
    broken = "_broken"
    known = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    row = F.from_xml(text, T.StructType([*known.fields, T.StructField(broken, T.StringType())]), {**_OPTIONS, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken})
    return F.when(row[broken].isNull(), row)


def infer(spark: SparkSession, example: str) -> T.StructType:
    """The schema of an example, to be stated for all texts of its kind."""
    return T._parse_datatype_string(spark.range(1).select(F.schema_of_xml(F.lit(example), _OPTIONS).alias("s")).first().s)


def rss_entries(docs: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """keys, pos, feed (title, link, description, language) and of each entry id, title, link, content, author, updated (ISO)
    and tags, as `feeds.entries` names them. No Python, no shuffle."""
    feed = F.col("_feed")
    found = docs.select(*keys, parse(F.col(column), RSS).alias("_feed")).filter("_feed is not null")
    listed = F.coalesce(feed["channel"]["item"], feed["item"])
    flat = found.select(*keys, F.struct(*[feed["channel"][c].alias(c) for c in ("title", "link", "description", "language")]).alias("feed"), F.posexplode(listed).alias("pos", "e"))
    e = F.col("e")
    updated = F.date_format(dates.parse(F.coalesce(e["pubDate"], e["date"])), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return flat.select(
        *keys, "pos", "feed", F.coalesce(e["guid"], e["link"]).alias("id"), e["title"].alias("title"), e["link"].alias("link"), F.coalesce(e["encoded"], e["description"]).alias("content"),
        F.coalesce(e["author"], e["creator"]).alias("author"), updated.alias("updated"), e["category"].alias("tags"),
    )


def read_rows(spark: SparkSession, path: str, row_tag: str, schema: str | T.StructType) -> DataFrame:
    """A row for each element of that name in the files of a path.

    Files are cut behind its end tags, so that a large one is read in as many tasks as it has splits; the XML source itself
    would take a task for each. Elements may not lie within each other, nor end tags stand within their text.
    """
    ended = spark.read.option("lineSep", f"</{row_tag}>").text(path)
    opened = F.regexp_extract("value", rf"(?s)<{row_tag}(?:\s[^>]*)?>(?!.*<{row_tag}[\s>]).*\z", 0)
    found = ended.select(opened.alias("v")).filter("v <> ''").select(parse(F.concat("v", F.lit(f"</{row_tag}>")), schema).alias("r"))
    known = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return found.filter("r is not null").select(*[F.col("r").getField(f.name).alias(f.name) for f in known.fields])


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Entries of feed files of any size: the fields of an item."""
    return read_rows(spark, path, "item", ITEM)
