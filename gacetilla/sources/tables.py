"""Reading input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; Spark splits its files (``spark.sql.files.*``)."""
    return spark.read.parquet(path)
