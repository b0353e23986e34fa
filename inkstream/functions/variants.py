"""JSON as variants: parsed once in the JVM, read by paths of slugs, without a schema and without Python.

Texts that are no JSON are null. Keys are compared as slugs (letters, digits, underscores and colons; `objects.slug_key`);
of keys with one slug the last in the order of keys counts. Empty texts are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OBJECT, _LIST = "map<string,variant>", "array<variant>"


def parse(text: Column) -> Column:
    """A variant of JSON, or of JSON in a call of a function."""
    inner = F.regexp_extract(text, r"(?s)^\s*[\w.$]+\s*\((.*)\)\s*;?\s*$", 1)
    return F.try_parse_json(F.when(inner != "", inner).otherwise(text))


def slug(key: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(key, "[^A-Za-z0-9:]+", "_"), "^_+|_+$", "")


def text(v: Column) -> Column:
    """A scalar as text, objects and lists as JSON; null for nothing."""
    return F.try_variant_get(v, "$", "string")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f names it: what stands in functions of elements is made anew for
    each mention and each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fields(v: Column) -> Column:
    """An object's values by slugs, without empty texts; null for what is no object."""
    entries = F.map_entries(F.try_variant_get(v, "$", _OBJECT))
    named = F.transform(entries, lambda e: F.named_struct(F.lit("key"), slug(e["key"]), F.lit("value"), e["value"]))
    kept = F.filter(named, lambda e: ~F.coalesce(text(e["value"]) == "", F.lit(False)))
    # Later entries of one slug win: the map is built from those that no later one shares it with.
    last = lambda kept, keys: F.filter(kept, lambda e, i: F.array_position(F.slice(keys, i + 2, F.size(keys)), e["key"]) == 0)
    return F.map_from_entries(_once(kept, lambda k: _once(F.transform(k, lambda e: e["key"]), lambda keys: last(k, keys))))


def elements(v: Column) -> Column:
    """A list's elements; of anything else that is there a list of it alone."""
    alone = lambda x: F.when(x.isNotNull() & ~F.is_variant_null(x), F.array(x)).otherwise(F.array().cast(_LIST))
    return _once(v, lambda x: F.coalesce(F.try_variant_get(x, "$", _LIST), alone(x)))


def at(v: Column, path: str) -> Column:
    """What stands at a path of slugs, `a.b.c`; on the way a list stands for its first element."""
    for step in path.split(".") if path else []:
        v = _once(v, _reader(step))
    return v


def _reader(step: str) -> Callable[[Column], Column]:
    return lambda x: _field(F.coalesce(F.get(F.try_variant_get(x, "$", _LIST), F.lit(0)), x), step)


def _field(v: Column, name: str) -> Column:
    """`fields(v)[name]`, without the other fields."""
    said = F.filter(F.map_entries(F.try_variant_get(v, "$", _OBJECT)), lambda e: (e["key"] == name) | (slug(e["key"]) == name))
    return F.try_element_at(F.filter(said, lambda e: ~F.coalesce(text(e["value"]) == "", F.lit(False))), F.lit(-1))["value"]


def items(payloads: DataFrame, column: str, keys: list[str], page: str, path: str, page_limit: int = 3, item_limit: int = -1) -> DataFrame:
    """Items of saved pages: keys, page, index (from 0 over all pages of the keys) and the item as a variant. -1: no limit.

    Items are numbered from the counts of the pages before, which are small, so that items themselves are not shuffled.
    """
    some = payloads.filter(F.col(page) <= page_limit) if page_limit >= 0 else payloads
    listed = some.select(*keys, F.col(page).alias("page"), elements(at(parse(F.col(column)), path)).alias("_items"))
    before = F.coalesce(F.sum(F.size("_items")).over(Window.partitionBy(*keys).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    flat = listed.withColumn("_before", before).select(*keys, "page", "_before", F.posexplode("_items").alias("_pos", "item"))
    numbered = flat.select(*keys, "page", (F.col("_before") + F.col("_pos")).cast("int").alias("index"), "item")
    return numbered.filter(F.col("index") < item_limit) if item_limit >= 0 else numbered


def inlined(v: Column) -> Column:
    """Objects by their ids, as a service of entities gives them, with what their fields refer to in place of references:
    a text that is the id of an object of the answer. Objects put in keep their own references."""
    known = F.try_variant_get(v, "$", _OBJECT)
    put = lambda x: F.coalesce(F.try_element_at(known, text(x)), x)
    return F.transform_values(known, lambda k, o: F.transform_values(F.try_variant_get(o, "$", _OBJECT), lambda name, x: put(x)))


def by_group(v: Column, group: str = "_typeGroup") -> Column:
    """Array of (group, id, object) of objects by their ids that say which group they are of."""
    entries = F.map_entries(F.try_variant_get(v, "$", _OBJECT))
    named = F.transform(entries, lambda e: F.named_struct(F.lit("group"), text(F.try_variant_get(e["value"], f"$.{group}", "variant")), F.lit("id"), e["key"], F.lit("object"), e["value"]))
    return F.filter(named, lambda e: e["group"].isNotNull())
