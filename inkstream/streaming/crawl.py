"""The crawl as streams. The same functions serve a running trigger and, with availableNow, a finite input."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.operators import versioned
from inkstream.operators.runs import first_wins

#: Seconds for which a cached page is fresh, and after which it is dropped (the reference values of a polite crawl).
FRESH_S, STALE_S = 300, 30 * 86_400


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream; files_per_trigger caps the parallel work of a batch."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    p = PurePosixPath(path)
    if p.suffix == ".parquet" and not _is_folder(spark, path):  # one file among others in its folder
        return reader.option("pathGlobFilter", p.name).option("recursiveFileLookup", True).parquet(path.rsplit("/", 1)[0])
    return reader.parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path of any store that Spark reads is a folder, as tables that Spark wrote are."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def once_each(pages: DataFrame, key: str, ts: str, delay: str = "1 day") -> DataFrame:
    """Each key once in the span of the watermark; state older than that is let go."""
    return pages.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, ts: str, key: str, size: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts by event-time window and key; late rows count as long as the watermark has not passed."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, size, slide or size), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), key, "n")


def upsert_into(path: str, keys: list[str], order: list[str]):
    """A foreachBatch function: of each batch the first row of every key that the table lacks is added.

    The table lies in buckets of its keys; of it the keys in the batch's buckets are read, whatever the batch's number. A
    batch that is repeated, also under a new checkpoint, finds its keys and adds nothing; one that broke off adds what it
    had not yet. Null is a key like any other.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = first_wins(batch, keys, order).withColumn("bucket", versioned.bucket_of(keys))
        if versioned.exists(spark, path):
            buckets = [r.bucket for r in new.select("bucket").distinct().collect()]  # BUCKETS rows at most
            earlier = spark.read.schema(new.schema).parquet(path).filter(F.col("bucket").isin(buckets))
            held = earlier.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)])
            new = new.join(held, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)], "left_anti")
        new.write.mode("append").partitionBy("bucket").parquet(path)

    return write


def upserted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that upsert_into has put into a table."""
    return spark.read.schema(f"{schema}, bucket int").parquet(path).drop("bucket")


def finish(stream: DataFrame, checkpoint: str, write=None, name: str | None = None, mode: str = "append") -> None:
    """Runs a stream over all that is there and ends: batches go to `write`, or rows to a table in memory."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode(mode)
    query = (writer.foreachBatch(write) if write else writer.format("memory").queryName(name)).start()
    query.awaitTermination()


def poll(stream: DataFrame, checkpoint: str, write, every: str = "60 seconds"):
    """Starts the running form: a batch at every interval."""
    return stream.writeStream.trigger(processingTime=every).option("checkpointLocation", checkpoint).foreachBatch(write).start()


def usable_cache(cache: DataFrame, now) -> DataFrame:
    """Cached pages with whether they are fresh; those gone stale are left out. Pages not found are cached as well."""
    age = F.unix_timestamp(now) - F.unix_timestamp("fetched_at")
    return cache.filter(age < STALE_S).withColumn("fresh", age < FRESH_S)
