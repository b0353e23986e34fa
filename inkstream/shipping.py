"""Lets Python workers import this package from where the driver did. Clusters whose machines do not share that place
get the package with --py-files; there the further entry on the path does nothing."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> None:
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in known:
        env["PYTHONPATH"] = ":".join([ROOT, *known])
