"""Facets as bitmaps of document numbers: counts within any result are intersections, no document is read again.

A bitmap covers 32,768 numbers in 4 KB, so a value of any frequency is a row of that size for each such range, combined
in every task before it is shuffled. Filters are bitmaps as well: `having` gives those of values, `both` and `either`
combine them, and `counts_within` counts all facets of what is left. Numbers are integers, negative ones too; null
numbers and null values are left out, repeated ones count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges of a result (4 KB each) up to which it is broadcast; larger ones are joined by range.
BROADCAST_RANGES = 2_000


def _at(key: str):
    number = F.col(key).cast("long")
    return F.bitmap_bucket_number(number).alias("range"), F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bitmap")


def facet_bitmaps(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(facet, value, range, bitmap) of array fields: one pass and one shuffle for all of them."""
    number, bits = _at(key)
    each = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("all")) for f in fields])
    flat = docs.filter(F.col(key).isNotNull()).select(key, F.explode(each).alias("f")).select(key, "f.facet", F.explode("f.all").alias("value"))
    return flat.filter("value is not null").groupBy("facet", "value", number).agg(bits)


def result_bitmaps(docs: DataFrame, key: str) -> DataFrame:
    """(range, bitmap) of a table's document numbers."""
    number, bits = _at(key)
    return docs.filter(F.col(key).isNotNull()).groupBy(number).agg(bits)


def having(bitmaps: DataFrame, facet: str, values: list[str]) -> DataFrame:
    """(range, bitmap) of the documents that have any of a facet's values."""
    chosen = bitmaps.filter((F.col("facet") == facet) & F.col("value").isin(values))
    return chosen.groupBy("range").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("range").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """What is in both; ranges that only one of them has are empty, so they go."""
    side = b.select("range", F.col("bitmap").alias("_b"))
    pairs = a.join(side, "range").select("range", F.explode(F.array("bitmap", "_b")).alias("bitmap"))
    return pairs.groupBy("range").agg(F.bitmap_and_agg("bitmap").alias("bitmap"))


def size(result: DataFrame) -> DataFrame:
    """One row: n, the documents of a result."""
    return result.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("n"))


def counts_within(bitmaps: DataFrame, result: DataFrame, facets: list[str] | None = None) -> DataFrame:
    """(facet, value, n): documents of the result that have each value, those of none left out."""
    chosen = bitmaps if facets is None else bitmaps.filter(F.col("facet").isin(facets))
    side = result.select("range", F.col("bitmap").alias("_r"))
    side = F.broadcast(side) if side.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES else side
    pairs = chosen.join(side, "range").select("facet", "value", "range", F.explode(F.array("bitmap", "_r")).alias("b"))
    joint = pairs.groupBy("facet", "value", "range").agg(F.bitmap_count(F.bitmap_and_agg("b")).alias("n"))
    return joint.groupBy("facet", "value").agg(F.sum("n").alias("n")).filter("n > 0")
