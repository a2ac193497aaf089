"""Scans of the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of the data directory: a Parquet file or a folder of them."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
