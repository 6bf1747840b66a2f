"""Sinks: canonical JSON reports and ledgers of rejected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import scratch


def write_report(report: DataFrame, path: str | None = None) -> str:
    """One JSON object a line with sorted keys and nulls kept."""
    path = path or scratch(report.sparkSession, "report")
    report.select(*sorted(report.columns)).write.option("ignoreNullFields", "false").json(path)
    return path


def write_ledger(scored: DataFrame, path: str | None = None, reason: str = "reason") -> str:
    """Accepted rows (null reason) and rejected rows beside each other, from one pass over the input."""
    path = path or scratch(scored.sparkSession, "ledger")
    scored.withColumn("verdict", F.when(F.col(reason).isNull(), "accepted").otherwise("rejected")).write.partitionBy("verdict").parquet(path)
    return path


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(path)
    return tuple(rows.where(F.col("verdict") == v).drop("verdict") for v in ("accepted", "rejected"))
