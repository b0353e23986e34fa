"""Lookups in dimension tables: codes, shortest and longest prefixes, contact cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.shared import settled
from inkstream.shipping import ship

#: Rows up to which a dimension is broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 100_000


def sized(dim: DataFrame) -> DataFrame:
    """The dimension, to be broadcast if it is found to be small."""
    return F.broadcast(dim) if dim.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else dim


def code_names(df: DataFrame, dim: DataFrame, code: str, dim_code: str, name: str, out: str) -> DataFrame:
    """Each row with the name of its code, without regard to case; null for unknown codes."""
    side = dim.select(F.lower(dim_code).alias("_code"), F.col(name).alias(out))
    return df.join(sized(side), F.lower(F.col(code).cast("string")) == F.col("_code"), "left").drop("_code")


def prefix_matches(df: DataFrame, dim: DataFrame, value: str, prefix: str, out: str, most: int | None = None) -> DataFrame:
    """df with `shortest` and `longest`: what the dimension has in `out` for the shortest and the longest of its prefixes
    that starts the value; null if none does. `most` leaves out longer prefixes.

    A prefix is an interval of sorted strings, and intervals are nested or apart. So distinct values and prefixes are sorted
    together into bins of like size, and one pass over each bin keeps the prefixes that are open; those that were opened in
    earlier bins are brought in from the bin's first string. Bins hold distinct strings, so no frequent value or crowded
    prefix makes one larger. Of a repeated prefix the least `out` counts; null values and prefixes match nothing.
    """
    once = dim.filter(F.col(prefix).isNotNull()).groupBy(F.col(prefix).alias("s")).agg(F.min(out).alias("out"))
    once = settled(once if most is None else once.filter(F.length("s") <= most), "prefixes")
    kind = dict(once.dtypes)["out"]
    rows = once.withColumn("asked", F.lit(False)).unionByName(df.select(F.col(value).alias("s")).filter("s is not null").distinct().select("s", F.lit(None).cast(kind).alias("out"), F.lit(True).alias("asked")))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    binned = settled(rows.repartitionByRange(n, "s").withColumn("bin", F.spark_partition_id()), "prefix-bins")
    lengths = [r.n for r in once.select(F.length("s").alias("n")).distinct().collect()]  # no more than the longest prefix has characters
    heads = binned.groupBy("bin").agg(F.min("s").alias("head"))
    tried = F.explode(F.transform(F.array(*map(F.lit, lengths or [0])), lambda k: F.substring("head", F.lit(1), k))).alias("s")
    open_ = heads.select("bin", "head", tried).filter("s <> head").distinct().join(once, "s").select("s", "out", F.lit(False).alias("asked"), "bin")
    swept = binned.select("s", "out", "asked", "bin").unionByName(open_).repartition(n, "bin").sortWithinPartitions("bin", "s", "asked")
    ship(df.sparkSession)
    found = swept.mapInArrow(_sweep(kind), f"s string, shortest {kind}, longest {kind}")
    return df.join(found.withColumnRenamed("s", value), value, "left")


def _sweep(kind: str):
    def run(batches):
        import pyarrow as pa

        schema = None
        bin_, held = None, []  # prefixes that are open, each within the one before, with what they stand for
        for batch in batches:
            schema = schema or pa.schema([("s", pa.string()), ("shortest", batch.schema.field("out").type), ("longest", batch.schema.field("out").type)])
            found = []
            for s, out, asked, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != bin_:
                    bin_, held = at, []
                while held and not s.startswith(held[-1][0]):
                    held.pop()
                if not asked:
                    held.append((s, out))
                else:
                    found.append((s, held[0][1], held[-1][1]) if held else (s, None, None))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def prefix_column(value: Column, table: dict[str, str], longest: bool = False) -> Column:
    """The entry of a small fixed table for the shortest (or longest) of its keys that starts the value."""
    keys = sorted(table, key=len, reverse=longest)
    return F.coalesce(*[F.when(value.startswith(k), F.lit(table[k])) for k in keys], F.lit(None).cast("string"))


def shortest_prefix(df: DataFrame, dim: DataFrame, value: str, prefix: str, out: str, most: int | None = 3) -> DataFrame:
    """As with calling codes: the dimension's `out` for the shortest prefix of the value that it has."""
    return prefix_matches(df, dim, value, prefix, out, most).drop("longest").withColumnRenamed("shortest", out)


def longest_prefix(df: DataFrame, dim: DataFrame, value: str, prefix: str, out: str, most: int | None = None) -> DataFrame:
    """As with credentials by path: the dimension's `out` for the longest prefix of the value that it has."""
    return prefix_matches(df, dim, value, prefix, out, most).drop("shortest").withColumnRenamed("longest", out)


#: First words of names that are titles (fixed values).
HONORIFICS = ("mr.", "ms.", "miss", "dr.", "sir", "madam", "m.", "mmes.")


def split_name(fn: Column) -> dict[str, Column]:
    """Prefix, given, additional and family names and suffix of a formatted name, by its words: a first one with a
    comma goes last, a title is the prefix, then come given and (of three and more) additional, family and suffix."""
    words = F.filter(F.split(fn, r"\s+"), lambda x: x != "")
    first = F.get(words, F.lit(0))
    rest = lambda x: F.slice(x, 2, F.greatest(F.size(x), F.lit(1)))
    turned = F.when(first.endswith(","), F.concat(rest(words), F.array(F.regexp_replace(first, ",$", "")))).otherwise(words)
    titled = F.coalesce(F.lower(F.get(turned, F.lit(0))).isin(*HONORIFICS), F.lit(False))
    names = F.transform(F.when(titled, rest(turned)).otherwise(turned), lambda x: F.regexp_replace(x, ",+$", ""))
    n = F.size(names)
    return {
        "honorific_prefix": F.when(titled, F.get(turned, F.lit(0))),
        "given_name": F.get(names, F.lit(0)),
        "additional_name": F.when(n >= 3, F.get(names, F.lit(1))),
        "family_name": F.when(n == 2, F.get(names, F.lit(1))).when(n >= 3, F.get(names, F.lit(2))),
        "honorific_suffix": F.when(n >= 4, F.get(names, F.lit(3))),
    }


def scrub_name(fn: Column, org: Column, email: Column, otherwise: str = "No Name") -> Column:
    """A name to show: the formatted name, else the organisation, else the email. Of an address it is the local part in
    capitalised words; else quotes around it and comments go, and every word opens with a capital."""
    from inkstream.functions.text import capwords

    found = F.coalesce(F.nullif(fn, F.lit("")), F.nullif(org, F.lit("")), email, F.lit(""))
    local = capwords(F.regexp_replace(F.substring_index(found, "@", 1), "[^-A-Za-z0-9]", " "))
    bare = F.regexp_replace(F.regexp_replace(found, r"""^(['"])(.*)\1$""", "$2"), r"\([^)]*\)", " ")
    words = F.filter(F.split(bare, r"\s+"), lambda x: x != "")
    shown = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")
    return F.coalesce(F.nullif(F.when(F.contains(found, F.lit("@")), local).otherwise(shown), F.lit("")), F.lit(otherwise))


def scrub_email(c: Column) -> Column:
    """Lower case, without mailto: and what follows a question mark; null if it is no address."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), "^(?i)mailto:", ""), r"\?.*$", ""))
    return F.when(valid_email(bare), bare)


def valid_email(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$")


def valid_uri(c: Column, schemes: tuple[str, ...] = ("http", "https")) -> Column:
    return c.rlike(f"^({'|'.join(schemes)})://[^\\s/?#]+[^\\s]*$")


def phone_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def valid_language(c: Column) -> Column:
    """Of the form of a language tag: a language, then script, region and variants."""
    return c.rlike(r"^[A-Za-z]{2,3}(-[A-Za-z]{4})?(-([A-Za-z]{2}|\d{3}))?(-([A-Za-z0-9]{5,8}|\d[A-Za-z0-9]{3}))*$")


def valid_mime_type(c: Column) -> Column:
    """A type, a subtype and any number of parameters."""
    token = r"[!#$%&'*+.^_`|~0-9A-Za-z-]+"
    return c.rlike(rf"""^{token}/{token}(\s*;\s*{token}=({token}|"[^"]*"))*$""")
