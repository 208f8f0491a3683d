"""Access to the parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; Spark prunes its columns and pushes filters down."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
