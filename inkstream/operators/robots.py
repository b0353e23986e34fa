"""Which pages a crawler may fetch, by the rules that hosts publish."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.functions import urls
from inkstream.sources.arrow import parse_column

RULES = "array<struct<allow:boolean,path:string>>"


def rules_of(text: str, agent: str = "*") -> list[dict]:
    """The rules for an agent, or those for all where it has none of its own."""
    groups: dict[str, list[dict]] = {}
    names: list[str] = []
    open_group = False
    for line in text.splitlines():
        field, _, value = re.sub("#.*", "", line).partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            names = [*names, value.lower()] if open_group else [value.lower()]
            open_group = True
            for n in names:
                groups.setdefault(n, [])
        elif field in ("allow", "disallow"):
            open_group = False
            for n in names:
                if value:
                    groups[n].append({"allow": field == "allow", "path": value})
    own = next((n for n in groups if n != "*" and n in agent.lower()), "*")
    return groups.get(own, [])


def read_rules(hosts: DataFrame, text: str, agent: str = "*") -> DataFrame:
    return parse_column(hosts, text, lambda t: rules_of(t, agent), "rules", RULES)


def may_fetch(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Pages that the longest matching rule of their host allows; no rule allows. rules: host, rules.

    The join is on the host; of equally long rules one that allows wins.
    """
    place = F.when(urls.path(F.col(url)) == "", "/").otherwise(urls.path(F.col(url)))
    met = pages.withColumn("_host", F.lower(urls.host(F.col(url)))).join(rules.select(F.col("host").alias("_host"), F.col("rules").alias("_rules")), "_host", "left")
    fits = F.filter("_rules", lambda r: F.startswith(place, r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["path"]).alias("n"), r["allow"].alias("allow"))))
    return met.filter(F.coalesce(best["allow"], F.lit(True))).drop("_host", "_rules")
