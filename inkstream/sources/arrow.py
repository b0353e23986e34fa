"""Python parsers over a column, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from inkstream.shipping import ship


#: Rows, and bytes of the column that is parsed, that are Python objects at a time.
SLICE_ROWS, SLICE_BYTES = 1_024, 1 << 20
#: Bytes of a batch that Spark gives to a worker, which holds two of them at a time; a longer row is a batch of its own or its last.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bytes of an Arrow batch (64 MB by default) to BATCH_BYTES; what is lower already stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, column: str | int, rows: int = SLICE_ROWS, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of at most so many rows and bytes of a column of texts; a longer text is a run of its own. What is
    made of a run is given on before the next is read, so a worker's memory does not grow with its batches."""
    values, at = batch.column(column), 0
    long = pa.types.is_string(values.type) or pa.types.is_large_string(values.type) or pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type)
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64) if long else np.zeros(len(values), np.int64)
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = min(max(int(np.searchsorted(ends, before + limit, side="right")), at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def parse_column(df: DataFrame, column: str, parse: Callable[[object], object], out: str, kind: str, error: str | None = None) -> DataFrame:
    """df with a further column: parse(value) for each value; null stays null. Runs in Arrow batches, without a shuffle.

    A value that parse raises on gives null and leaves the other rows alone; `error` names a column for what it said.
    Lowers the session's bytes of an Arrow batch.
    """
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    added = f"{out} {kind}" + (f", {error} string" if error else "")
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(added).fields])
    arrow = to_arrow_schema(schema)
    field = arrow.field(len(df.columns))

    def one(value: object) -> tuple[object, str | None]:
        if value is None:
            return None, None
        try:
            return parse(value), None
        except Exception as e:  # texts of the open web: whatever a parser meets there concerns that text alone
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, column)):
            found = [one(v) for v in batch.column(column).to_pylist()]
            more = [pa.array([e for _, e in found], pa.string())] if error else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], field.type), *more], schema=arrow)

    return df.mapInArrow(run, schema)
