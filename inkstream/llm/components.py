"""Connected components of a link table, as DataFrame steps: alternating large and small stars.

Links are pairs of longs; null ends are no links, repeats and links of a node to itself count for nothing, and an
empty table has no components. A node that very many links meet is no hot key: the minima of a round are written
first, so the join of links with them is a plain one, which is broadcast if the minima are few and whose partitions AQE
may split if they are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.common import settle, sized


def _large(e: DataFrame, name: str) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it. Links go from larger to smaller, so
    a node's smaller neighbours are those it is the first end of; a node without any is the smallest itself."""
    least = settle(e.groupBy("u").agg(F.min("v").alias("m")), name).select(F.col("u").alias("v"), "m")
    return e.join(sized(least), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small(e: DataFrame, name: str) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = settle(e.groupBy("u").agg(F.min("v").alias("m")), name)
    moved = e.join(sized(least), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def stars(links: DataFrame, name: str) -> DataFrame:
    """(u, v): each linked node but the smallest of its component, with that smallest node.

    links has columns u and v in any order, repeats allowed. Each round is written to the shared folder; the number
    of rounds grows with the logarithm of the longest path.
    """
    e = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e = settle(e, name)
    mark = F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = tuple(e.agg(*mark).first())
    while before[0]:
        e = settle(_small(settle(_large(e, name), name), name), name)
        now = tuple(e.agg(*mark).first())
        if now == before:
            break
        before = now
    return e
