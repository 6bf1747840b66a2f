"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instants(df: DataFrame, column: str = "ts") -> DataFrame:
    """The naive timestamps of a column as instants in the session's zone, as watermarks and sinks need them."""
    return df.withColumn(column, F.col(column).cast("timestamp"))
