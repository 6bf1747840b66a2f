"""Outcome definitions as columns: canonical keys, pairwise comparison and registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("event", "process", "window", "thresholds")


def tidy(c: Column) -> Column:
    return F.lower(F.trim(c))


def canonical(df: DataFrame) -> DataFrame:
    """df (id, event, kind, params map, duration, unit, anchor, thresholds array of structs) -> id and a text per field.

    Names are trimmed and lower-cased; parameters and thresholds are sorted, so their order doesn't matter."""
    entry = lambda e: F.concat(tidy(e["key"]), F.lit("="), tidy(e["value"]))
    params = F.array_join(F.array_sort(F.transform(F.map_entries("params"), entry)), ",")
    bound = lambda t: F.concat_ws(" ", tidy(t["metric"]), t["operator"], t["value"].cast("string"), t["sustain"].cast("string"), tidy(t["unit"]))
    thresholds = F.array_join(F.array_sort(F.transform("thresholds", bound)), ",")
    return df.select(
        "id", tidy(F.col("event")).alias("event"), F.concat_ws(":", tidy(F.col("kind")), params).alias("process"),
        F.concat_ws(" ", F.col("duration").cast("string"), tidy(F.col("unit")), tidy(F.col("anchor"))).alias("window"), thresholds.alias("thresholds"),
    )


def compared(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """(first, second, relation, differing) for pairs of canonical definitions that meet the condition."""
    a = left.select(*(F.col(c).alias(f"a_{c}") for c in left.columns))
    b = right.select(*(F.col(c).alias(f"b_{c}") for c in right.columns))
    differing = F.filter(F.array(*(F.when(F.col(f"a_{f}") != F.col(f"b_{f}"), F.lit(f)) for f in FIELDS)), lambda x: x.isNotNull())
    both = a.join(b, on).withColumn("differing", differing)
    hard = F.arrays_overlap("differing", F.array(F.lit("event"), F.lit("process")))
    relation = F.when(F.size("differing") == 0, "direct").when(hard, "irreducible").otherwise("bridgeable")
    return both.select(F.col("a_id").alias("first"), F.col("b_id").alias("second"), relation.alias("relation"), F.array_join("differing", ",").alias("differing"))
