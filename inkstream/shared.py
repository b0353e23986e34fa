"""Tables in the folder that driver and executors share: they end a plan's lineage and outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, else that of the session's checkpoints, else (local mode, as in tests) one of
    our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="inkstream-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as a table and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkstream/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
