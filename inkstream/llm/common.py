"""What the corpus operators share: bounded Arrow batches, the shared folder, stable row ids."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstream.shared import shared_dir
from inkstream.shipping import ship

#: Text bytes that one step of a Python kernel holds; a longer single text is a step of its own.
SLICE_BYTES = 2 << 20
#: Rows that Spark hands to Python at once. Texts may be long, so the default of 10,000 could be gigabytes.
BATCH_ROWS = 256
#: Rows of numbers (some 20 bytes each) that may be broadcast.
BROADCAST_ROWS = 200_000


def column_at(names: list[str], name: str) -> int:
    """Place of the column of that name, else of the first that differs from it in case only."""
    hits = [i for i, c in enumerate(names) if c == name] or [i for i, c in enumerate(names) if c.lower() == name.lower()]
    if not hits:
        raise ValueError(f"no column {name!r} in {names}")
    return hits[0]


def project(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, as out=in, picked by position: further columns may clash with them in any way."""
    at = {out: column_at(df.columns, name) for out, name in wanted.items()}
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_c{i}").alias(out) for out, i in at.items()])


def text_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the column's bytes stay under the limit, or hold one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(value_lengths(batch.column(text)))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def value_lengths(array: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array one after another, and the n + 1 places where values start; null is empty."""
    lengths = value_lengths(array)
    starts = np.zeros(len(array) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    if not starts[-1]:
        return np.zeros(0, np.uint8), starts
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    _, offsets, data = array.buffers()
    wide = np.int64 if array.type in (pa.large_string(), pa.large_binary()) else np.int32
    first = int(np.frombuffer(offsets, wide)[array.offset])
    return np.frombuffer(data, np.uint8)[first : first + int(starts[-1])], starts


def encoded(array: pa.Array) -> list[bytes]:
    """The values in UTF-8; null is empty."""
    raw, at = utf8(array)
    whole, at = raw.tobytes(), at.tolist()
    return [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def strings(array: pa.Array) -> list[str]:
    return [x or "" for x in array.to_pylist()]


def map_slices(df: DataFrame, kernel: Callable[[pa.RecordBatch], dict], schema: T.StructType | str, text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """kernel: bounded slice -> its output columns by name. No shuffle. Lowers the session's Arrow batch size."""
    from pyspark.sql.pandas.types import to_arrow_schema

    prepare(df.sparkSession)
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, text, limit):
            out = kernel(piece)
            yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) and x.type == f.type else pa.array(x, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def prepare(spark: SparkSession) -> None:
    """Bounded batches, and workers that find this package, for every step in Python that follows."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def settle(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder as a table and read again: lineage ends here, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkstream/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    del df
    release(spark)
    return out


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A settled table of row numbers, to be broadcast if it has few rows; else its join shuffles both sides."""
    return F.broadcast(df) if df.count() <= most else df


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of steps whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def with_row_key(df: DataFrame, key: str) -> DataFrame:
    """df with column _row, a long that identifies each row, also among repeated or null ids.

    Where the key is a unique long it serves itself and nothing is written; otherwise the rows are numbered and
    written to the shared folder, so that every later pass sees the same numbers.
    """
    if dict(df.dtypes)[key] in ("bigint", "int", "smallint"):
        odd = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull())
        if odd.isEmpty():
            return df.withColumn("_row", F.col(key).cast("long"))
    return settle(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
