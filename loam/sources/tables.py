"""Parquet table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; the folder may hold a file or a directory of that name."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
