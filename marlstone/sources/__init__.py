"""Table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` (one file or a folder of files) below `sf_dir`, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
