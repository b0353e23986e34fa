"""Type coercion and dot paths as Columns: what cannot be read gives the other value, never an error."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words for true and false (fixed values).
TRUE, FALSE = ("t", "true", "y", "yes", "1"), ("f", "false", "n", "no", "0")


def to_int(c: Column, other: int | None = 0) -> Column:
    """What stands before the first point as an integer."""
    return F.coalesce(F.trim(F.regexp_replace(c.cast("string"), r"\..*$", "")).try_cast("bigint"), F.lit(other))


def to_float(c: Column, other: float | None = 0.0) -> Column:
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(other))


def to_bool(c: Column, other: bool | None = False) -> Column:
    """Words for true and false; other numbers by being zero; null gives the other value and other text is true."""
    word = F.lower(F.trim(c.cast("string")))
    number = word.try_cast("bigint")
    return F.when(word.isNull() | (word == ""), F.lit(other)).when(word.isin(*TRUE), True).when(word.isin(*FALSE), False).when(number.isNotNull(), number != 0).otherwise(True)


def to_list(c: Column, sep: str | None = None) -> Column:
    """The text's parts between separators, or a list of it alone; null is the empty list."""
    from inkstream.functions.text import split

    parts = split(c, sep) if sep else F.array(c)
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(parts)


def to_enum(c: Column, allowed: list[str], other: str | None = None) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(F.lit(other))


def path_parts(path: str) -> list[str | int]:
    """Parts of a path such as a.b[2]."'c d'" : names, and list positions as numbers."""
    out: list[str | int] = []
    for name, quoted, index in re.findall(r"""([^.\[\]"']+)|["']([^"']*)["']|\[(\d+)\]""", path):
        out.append(int(index) if index else quoted or name)
    return out


def json_path(c: Column, path: str) -> Column:
    """Text of a path within JSON text; null where there is nothing."""
    steps = "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path_parts(path))
    return F.get_json_object(c, "$" + steps)


def field(c: Column, path: str, kind: T.DataType | None = None) -> Column:
    """A path within structs, maps and arrays; null where there is nothing.

    With the column's type: a list met by name means its first element, [0] of what is no list means that itself, any
    other position of it nothing, and a further part of a plain value that value. Without a type names go into structs
    and maps, and positions into lists.
    """
    for part in path_parts(path):
        if kind is None:
            c = F.get(c, part) if isinstance(part, int) else c[part]
            continue
        if isinstance(part, int):
            if isinstance(kind, T.ArrayType):
                c, kind = F.get(c, part), kind.elementType
            elif part:
                return F.lit(None)
            continue
        while isinstance(kind, T.ArrayType):
            c, kind = F.get(c, 0), kind.elementType
        if isinstance(kind, T.MapType):
            c, kind = F.try_element_at(c, F.lit(part)), kind.valueType
        elif isinstance(kind, T.StructType):
            if part not in kind.names:
                return F.lit(None)
            c, kind = c[part], kind[part].dataType
    return c


def extract(df: DataFrame, path: str) -> Column:
    """A path that opens with a column of df, by the types of its schema; null if there is no such column."""
    name, *rest = path_parts(path)
    if name not in df.columns:
        return F.lit(None)
    return field(df[name], "".join(f"[{p}]" if isinstance(p, int) else f".'{p}'" for p in rest), df.schema[name].dataType)


def find_key(m: Column, *wanted: str) -> Column:
    """Of a map's dotted keys that have all the wanted parts, the value of the shortest, then first in order."""
    hit = F.map_filter(m, lambda k, _: F.size(F.array_except(F.array(*map(F.lit, wanted)), F.split(k, r"\."))) == 0)
    return F.array_min(F.transform(F.map_entries(hit), lambda e: F.struct(F.length(e["key"]).alias("n"), e["key"].alias("k"), e["value"].alias("v"))))["v"]
