"""A table of articles in buckets, with a log of commits and the history of every row.

Under a folder: `rows/commit=/bucket=` holds, for each commit, the buckets it touched as they are since; `history/commit=`
the rows that it closed; `log/commit=` its id, time and buckets. A bucket's rows are those of the last commit that touched
it, so a merge reads and rewrites the touched buckets only. The log entry is written last: a commit without one does not
count, and its files are written anew by the next. One writer at a time.

Rows are told apart by their keys (null is a key like any other). Every row has valid_from; history rows also valid_to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstream.operators.runs import first_wins

BUCKETS = 64
_LOG = "id string, at timestamp, buckets array<int>, commit long"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def log(spark: SparkSession, path: str) -> DataFrame:
    """(id, at, buckets, commit): a row for each commit."""
    if not exists(spark, f"{path}/log"):
        return spark.createDataFrame([], _LOG)
    return spark.read.schema(_LOG).parquet(f"{path}/log")


def bucket_of(keys: list[str]) -> Column:
    """The bucket of a row, by its keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _schema(df: DataFrame, *more: str) -> T.StructType:
    plain = [T.StructField(f.name, f.dataType) for f in df.schema.fields]
    return T.StructType([*plain, *(T.StructField(m, T.TimestampType()) for m in more), T.StructField("bucket", T.IntegerType())])


def _buckets(spark: SparkSession, path: str, wanted: set[int] | None = None) -> list[str]:
    """The folders that hold the rows of the wanted buckets now: one for each at most."""
    last: dict[int, int] = {}
    for r in log(spark, path).select("buckets", "commit").collect():  # a row for each commit
        for b in r.buckets:
            last[b] = max(last.get(b, -1), r.commit)
    found = [f"{path}/rows/commit={c}/bucket={b}" for b, c in sorted(last.items()) if wanted is None or b in wanted]
    return [f for f in found if exists(spark, f)]  # a bucket whose rows were all deleted has no folder


def _rows(spark: SparkSession, path: str, schema: T.StructType, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], T.StructType(schema.fields[:-1]))
    return spark.read.schema(T.StructType(schema.fields[:-1])).parquet(*folders)


def current(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The rows as they are, with valid_from."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType([*kind.fields, T.StructField("valid_from", T.TimestampType()), T.StructField("bucket", T.IntegerType())])
    return _rows(spark, path, full, _buckets(spark, path))


def history(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """All rows that ever were, with valid_from and valid_to (null: still valid)."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    now = current(spark, path, kind).withColumn("valid_to", F.lit(None).cast("timestamp"))
    commits = [r.commit for r in log(spark, path).select("commit").collect()]
    folders = [f for f in (f"{path}/history/commit={c}" for c in commits) if exists(spark, f)]
    if not folders:
        return now
    closed = T.StructType([*kind.fields, T.StructField("valid_from", T.TimestampType()), T.StructField("valid_to", T.TimestampType())])
    return now.unionByName(spark.read.schema(closed).parquet(*folders))


def as_of(spark: SparkSession, path: str, schema: str | T.StructType, at: Column) -> DataFrame:
    """The rows that were valid at a time."""
    rows = history(spark, path, schema).filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    return rows.drop("valid_from", "valid_to")


def merge(path: str, found: DataFrame, keys: list[str], at: Column, order: list[str] | None = None, commit: str | None = None, gone: DataFrame | None = None, insert_only: bool = False) -> int | None:
    """Found rows in place of stored ones of the same keys; what a found row leaves null stays as stored. gone: keys of rows
    to delete. With insert_only stored rows stay as they are.

    Of found rows of one key the first by `order` (else by all columns) counts. A row that changes closes its earlier form
    in the history; one that does not is left alone, so a merge that is repeated adds nothing. A commit whose id is in the
    log is not done again. Returns the commit's number, null if nothing was to be done.
    """
    spark = found.sparkSession
    done = {r.id: r.commit for r in log(spark, path).select("id", "commit").collect()}
    if commit is not None and commit in done:
        return None
    number = max(done.values(), default=-1) + 1
    rest = [c for c in found.columns if c not in keys]
    new = first_wins(found, keys, order or [*rest, *keys]).select(*found.columns)
    touched = new.select(bucket_of(keys).alias("b"))
    if gone is not None:
        touched = touched.union(gone.select(bucket_of(keys).alias("b")))
    buckets = sorted(r.b for r in touched.distinct().collect())  # BUCKETS rows at most
    if not buckets:
        return None
    full = _schema(found, "valid_from")
    stored = _rows(spark, path, full, _buckets(spark, path, set(buckets)))
    side = stored.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_{i}") for i, c in enumerate(rest)], F.col("valid_from").alias("_from"), F.lit(True).alias("_stored"))
    same_key = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    both = new.withColumn("_found", F.lit(True)).join(side, same_key, "full_outer")
    both = both.withColumns({k: F.when(F.col("_found").isNull(), F.col(f"_k{i}")).otherwise(F.col(k)) for i, k in enumerate(keys)})
    if gone is not None:
        lost = gone.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]).distinct().withColumn("_gone", F.col("_g0").isNull() | F.lit(True))
        both = both.join(lost, [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)], "left")
    else:
        both = both.withColumn("_gone", F.lit(None).cast("boolean"))
    there, came = F.col("_stored").isNotNull(), F.col("_found").isNotNull()
    keep = there if insert_only else F.lit(False)
    value = {c: F.when(keep, F.col(f"_{i}")).otherwise(F.coalesce(F.col(c), F.col(f"_{i}"))) for i, c in enumerate(rest)}
    differs = F.lit(False)
    for i, c in enumerate(rest):
        differs = differs | ~value[c].eqNullSafe(F.col(f"_{i}"))
    changed = there & came & differs
    deleted = F.col("_gone").isNotNull() & ~came  # a row that is found and gone is found
    state = both.withColumns({"_changed": changed, "_deleted": deleted}).withColumns({"_now": F.struct(*[value[c].alias(c) for c in rest]) if rest else F.struct(F.lit(1).alias("_"))})
    state = state.withColumn("bucket", bucket_of(keys))
    rows = state.filter(~F.col("_deleted")).select(*keys, *[F.col(f"_now.{c}").alias(c) for c in rest], F.when(there & ~F.col("_changed"), F.col("_from")).otherwise(at).alias("valid_from"), "bucket")
    rows.select(*found.columns, "valid_from", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/commit={number}")
    closed = state.filter(there & (F.col("_changed") | F.col("_deleted"))).select(*keys, *[F.col(f"_{i}").alias(c) for i, c in enumerate(rest)], F.col("_from").alias("valid_from"), at.alias("valid_to"))
    closed.select(*found.columns, "valid_from", "valid_to").write.mode("overwrite").parquet(f"{path}/history/commit={number}")
    entry = spark.range(1).select(F.lit(commit).cast("string").alias("id"), at.cast("timestamp").alias("at"), F.array(*map(F.lit, buckets)).cast("array<int>").alias("buckets"))
    entry.coalesce(1).write.mode("overwrite").parquet(f"{path}/log/commit={number}")
    return number
