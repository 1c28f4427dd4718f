"""Readers for the parquet tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """`<folder>/<name>.parquet`, by any path Spark can read."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
