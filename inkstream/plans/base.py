"""Registration of queries: a Spark function and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: The `now` of all queries, so that results can be repeated.
NOW = "2024-01-31 00:00:00"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of a task with much to do for each: a scan's tasks are cut by the bytes of its files, of which small columns have few.
ROWS_A_TASK = 25_000


def spread(df: DataFrame) -> DataFrame:
    """A table's rows over at least half as many partitions as there are cores, and as rows by ROWS_A_TASK, for steps in
    Python or on variants. df is a scan with projections, of which the rows are counted; give it before its rows are made longer."""
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))
    return df.repartition(wanted) if 2 * df._jdf.queryExecution().executedPlan().execute().getNumPartitions() <= wanted else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key, over at least as many partitions as there are cores: what is grouped by the keys needs no further
    shuffle, and steps in Python behind it are not coalesced into a few tasks."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL if SQL can express it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register
