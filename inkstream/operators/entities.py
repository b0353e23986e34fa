"""Entities of articles: routing by type, relevance, references, upsert, anchors in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entity types by kind (fixed values).
KINDS = {"person": ("Person",), "place": ("City", "Country", "Continent", "Facility", "Region"), "organisation": ("Organization", "Company")}
LEAST_RELEVANCE = 0.2
LEAST_TEXT = 100


def kind_of(entity_type: Column) -> Column:
    """person, place or organisation; null for types that are not kept."""
    out = F.lit(None).cast("string")
    for kind, types in KINDS.items():
        out = F.when(entity_type.isin(*types), kind).otherwise(out)
    return out


def analysable(text: Column) -> Column:
    return F.length(text) >= LEAST_TEXT


def relevant(df: DataFrame, types: list[str] | None = None, least: float = LEAST_RELEVANCE) -> DataFrame:
    out = df.filter(F.col("relevance") >= least)
    return out.filter(F.col("_type").isin(*types)) if types else out


def by_relevance(entities: Column) -> Column:
    """An array of structs with relevance, most relevant first; ties keep the reverse of their order."""
    return F.reverse(F.array_sort(entities, lambda a, b: F.when(a["relevance"] < b["relevance"], -1).when(a["relevance"] > b["relevance"], 1).otherwise(0)))


def of_article(links: DataFrame, entities: DataFrame, kind: str) -> DataFrame:
    """Entities of a kind with their articles; the bridge is filtered before the join."""
    return links.filter(F.col("entity_type") == kind).join(entities, "entity_id")


def inline_references(objects: DataFrame, key: str, reference: str) -> DataFrame:
    """Objects whose reference is another object's key, with that object's name in its place."""
    named = objects.select(F.col(key).alias("_ref"), F.col("name").alias("_name"))
    return objects.join(named, objects[reference] == named["_ref"], "left").withColumn(reference, F.coalesce("_name", reference)).drop("_ref", "_name")


def group_by_type(df: DataFrame, group: str = "_typeGroup") -> DataFrame:
    return df.groupBy(group).agg(F.sort_array(F.collect_list("name")).alias("names"))


def link_mentions(text: Column, mentions: Column) -> Column:
    """The text with an anchor around each mention (offset, length, uri), from the last to the first."""
    ordered = F.array_sort(mentions, lambda a, b: F.when(a["offset"] > b["offset"], -1).when(a["offset"] < b["offset"], 1).otherwise(0))
    put = lambda t, m: F.concat(F.substring(t, F.lit(1), m["offset"]), F.lit('<a href="'), m["uri"], F.lit('">'), F.substring(t, m["offset"] + 1, m["length"]), F.lit("</a>"), F.substring(t, m["offset"] + m["length"] + 1, F.length(t)))
    return F.aggregate(ordered, text, put)


def without_specifics(fields: Column, specific: tuple[str, ...] = ("instances", "relevance")) -> Column:
    """A map of fields without those that belong to one mention."""
    return F.map_filter(fields, lambda k, _: ~k.isin(*specific))


def geocoded(df: DataFrame, address: Column, gazetteer: DataFrame, order: str = "rank") -> DataFrame:
    """df with the coordinates of the first hit for its address in (address, latitude, longitude, order); null without one.
    Any DataFrame of these columns can be the gazetteer, such as the saved answers of a service."""
    hit = gazetteer.groupBy(F.lower("address").alias("_address")).agg(F.min_by(F.struct("latitude", "longitude"), order).alias("_hit"))
    found = df.withColumn("_line", F.lower(address)).join(hit, F.col("_line") == F.col("_address"), "left")
    return found.withColumns({"latitude": F.col("_hit.latitude"), "longitude": F.col("_hit.longitude")}).drop("_line", "_address", "_hit")


def address_line(*parts: Column) -> Column:
    """Parts of an address that are there, comma-joined, as a geocoder takes them."""
    return F.concat_ws(", ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])
