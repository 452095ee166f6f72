"""Named Parquet tables below one root path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table `name` below `root`; any path that Spark can read will do."""
    return spark.read.parquet(f"{root}/{name}.parquet")
