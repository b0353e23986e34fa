"""Flat records with dotted names, as maps: choosing, adding, removing, uniting and parting fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_parts(m: Column, *wanted: str) -> Column:
    """Entries whose dotted names have all the wanted parts."""
    return F.map_filter(m, lambda k, _: F.size(F.array_except(F.array(*map(F.lit, wanted)), F.split(k, r"\."))) == 0)


def without_parts(m: Column, *parts: str) -> Column:
    """Entries whose dotted names have none of the parts."""
    return F.map_filter(m, lambda k, _: ~F.arrays_overlap(F.array(*map(F.lit, parts)), F.split(k, r"\.")))


def without_marks(m: Column) -> Column:
    """Entries whose names do not begin with @."""
    return F.map_filter(m, lambda k, _: ~k.startswith("@"))


def add(m: Column, name: str, value: Column) -> Column:
    """The map with a further entry; a name that is taken gets the first free number behind it."""
    taken = lambda i: F.map_contains_key(m, F.concat(F.lit(f"{name}."), i.cast("string")))
    free = F.array_min(F.filter(F.sequence(F.lit(1), F.size(m) + 1), lambda i: ~taken(i)))
    key = F.when(F.map_contains_key(m, F.lit(name)), F.concat(F.lit(f"{name}."), free.cast("string"))).otherwise(F.lit(name))
    return F.map_concat(m, F.create_map(key, value))


def united(first: Column, second: Column) -> Column:
    """Both maps' entries, those of the first where both have one."""
    return F.map_concat(first, F.map_filter(second, lambda k, _: ~F.map_contains_key(first, k)))


def parted(m: Column, known: list[str]) -> tuple[Column, Column]:
    """Entries with known names, and the others."""
    return F.map_filter(m, lambda k, _: k.isin(*known)), F.map_filter(m, lambda k, _: ~k.isin(*known))


def assign(struct: Column, path: str, value: Column) -> Column:
    """The struct with a value at a path of names."""
    return struct.withField(path, value)


def loose(uris: Column, m: Column) -> Column:
    """Of the addresses met in a record those that are no field's value, each once."""
    return F.array_except(uris, F.map_values(m))
