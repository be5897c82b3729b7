"""Readers of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor directory; a path that only Spark's readers open is fine."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
