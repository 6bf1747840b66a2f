"""Idempotent inserts and key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_plan(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """(key, action) for each key of the batch: insert, same (equal content) or conflict. Contents are compared by digest."""
    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != key)), {"ignoreNullFields": "false"}), 256).alias(name))

    both = digest(batch, "_new").join(digest(stored, "_old"), key, "left")
    return both.select(key, F.when(F.col("_old").isNull(), "insert").when(F.col("_old") == F.col("_new"), "same").otherwise("conflict").alias("action"))


def orphans(child: DataFrame, parent: DataFrame, key: str, rule: str) -> DataFrame:
    """Rows of child without a parent, as (rule, key)."""
    return child.join(parent.select(key).distinct(), key, "left_anti").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
