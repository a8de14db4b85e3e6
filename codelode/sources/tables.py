"""Readers of the tables under one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """``directory/name.parquet``; filters and column pruning reach the scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
