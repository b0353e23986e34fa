"""Operators on order: consecutive runs, loop counters, change detection, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def regroup(df: DataFrame, key: str, within: list[str], order: list[str], values: str) -> DataFrame:
    """Consecutive rows of equal key as one row with the list of their values, in order; null keys are left out.

    Runs are gaps and islands over one window, so only `within` is shuffled on.
    """
    w = Window.partitionBy(*within).orderBy(*order)
    some = df.filter(F.col(key).isNotNull())
    new = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)), 0).otherwise(1)
    marked = some.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("_pos", F.row_number().over(w))
    listed = F.array_sort(F.collect_list(F.struct("_pos", F.col(values).alias("v"))))
    return marked.groupBy(*within, "run", key).agg(F.transform(listed, lambda x: x["v"]).alias("items"))


def loop_counters(w: WindowSpec, back: WindowSpec) -> dict[str, Column]:
    """Counters of a loop over a window and the same window in reverse."""
    n, r = F.row_number().over(w), F.row_number().over(back)
    return {"counter": n, "counter0": n - 1, "revcounter": r, "revcounter0": r - 1, "first": n == 1, "last": r == 1}


def changes(ts: Column, w: WindowSpec) -> dict[str, Column]:
    """Whether day, month and year differ from the row before; true for the first row."""
    formats = {"day_changed": "yyyy-MM-dd", "month_changed": "yyyy-MM", "year_changed": "yyyy"}
    return {k: ~F.date_format(ts, f).eqNullSafe(F.lag(F.date_format(ts, f)).over(w)) for k, f in formats.items()}


def repeating_name(name: str, w: WindowSpec) -> Column:
    """name.001, name.002 and so on."""
    return F.format_string(f"{name}.%03d", F.row_number().over(w))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, as one aggregate with map-side combining instead of a sorted window."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_first")).select(*keys, *[F.col("_first")[c].alias(c) for c in rest])


def zip_positions(left: DataFrame, right: DataFrame, keys: list[str], fields: str = "fields") -> DataFrame:
    """Rows of both sides at the same position as one, the right side's map entries winning; either may be missing."""
    a = left.select(*keys, F.col(fields).alias("_a"))
    b = right.select(*keys, F.col(fields).alias("_b"))
    none = F.create_map().cast("map<string,string>")
    own = F.coalesce(F.map_filter("_a", lambda k, _: ~F.coalesce(F.map_contains_key("_b", k), F.lit(False))), none)
    return a.join(b, keys, "full_outer").select(*keys, F.map_concat(F.when(F.col("_b").isNull(), F.coalesce("_a", none)).otherwise(own), F.coalesce("_b", none)).alias(fields))


def neighbours(c: Column, w: WindowSpec) -> dict[str, Column]:
    """The value before and the value behind, null at the ends."""
    return {"previous": F.lag(c).over(w), "following": F.lead(c).over(w)}
