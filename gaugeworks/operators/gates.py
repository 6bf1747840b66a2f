"""Corpus gates: row rules and set rules in one report of (gate, passed, failed)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failed_rows(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, gate), a row for each row and gate that it breaks, from one pass. A null rule counts as broken."""
    broken = F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()))
    return df.select(key, F.explode(F.filter(broken, lambda g: g.isNotNull())).alias("gate"))


def gate_report(failed: DataFrame, names: list[str]) -> DataFrame:
    """(gate, passed, failed) for all gates, those without a failure included."""
    per = failed.groupBy("gate").agg(F.count("*").alias("failed"))
    every = failed.sparkSession.createDataFrame([(n,) for n in names], "gate string")
    out = every.join(per, "gate", "left")
    return out.select("gate", F.col("failed").isNull().alias("passed"), F.coalesce("failed", F.lit(0)).alias("failed"))


def counts_grid(df: DataFrame, splits: list[str], classes: list[str]) -> DataFrame:
    """(split, a column for each class): counts, zero where there are no rows."""
    n = lambda c: F.coalesce(F.sum(F.when(F.col("outcome") == c, 1).otherwise(0)).cast("long"), F.lit(0)).alias(c)
    per = df.groupBy("split").agg(*map(n, classes))
    every = df.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    out = every.join(per, "split", "left")
    return out.select("split", *(F.coalesce(c, F.lit(0)).alias(c) for c in classes))


def worst(statuses: list[Column], order: tuple[str, ...] = ("fail", "inconclusive", "pass")) -> Column:
    """The first status of the order that any of the columns has."""
    some = lambda s: reduce(lambda a, b: a | b, [c == s for c in statuses])
    return F.coalesce(*(F.when(some(s), s) for s in order))


#: Fields that a capture's lane has to share with the frozen profile.
LANE = ("system_id", "service_id", "workload_reference", "horizon_rule", "outcome_threshold_rule", "capture_schema_version", "allowed_evidence_scope")


def lane_differences(profile: dict[str, str]) -> Column:
    """The lane fields in which a row differs from the profile, in the order of LANE; a null differs from any value. The
    profile is given, not taken from the rows that it judges."""
    if set(profile) != set(LANE):
        raise ValueError(f"a profile has the fields {', '.join(LANE)}")
    return F.filter(F.array(*(F.when(~F.col(f).eqNullSafe(F.lit(profile[f])), F.lit(f)) for f in LANE)), lambda f: f.isNotNull())


def terminal_records(selected: DataFrame, captures: DataFrame, key: str, profile: dict[str, str]) -> DataFrame:
    """(key, record, differing) for each selected revision once: its capture's outcome, lane mismatch where its lane is not
    the profile's, conflict where it has several captures, missing where it has none."""
    per = captures.withColumn("_d", lane_differences(profile)).groupBy(key).agg(F.count("*").alias("_n"), F.min("outcome").alias("_o"), F.max_by("_d", F.size("_d")).alias("differing"))
    record = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "conflict").when(F.size("differing") > 0, "lane mismatch").otherwise(F.col("_o"))
    return selected.select(key).join(per, key, "left").select(key, record.alias("record"), F.coalesce(F.array_join("differing", ","), F.lit("")).alias("differing"))


def manifest_error(splits: list[str], classes: list[str]) -> Column:
    """The first rule that a manifest breaks, null if none: rows with source_system, release_scope and horizon_rule,
    thresholds_frozen, split_definitions (an array) and counts_by_split, a map of splits to maps of classes to counts.
    A null field is a missing one."""
    fields = ("counts_by_split", "horizon_rule", "release_scope", "source_system", "split_definitions", "thresholds_frozen")
    missing = F.filter(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in fields)), lambda f: f.isNotNull())
    checks = [F.when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", ")))]
    checks += [F.when(F.trim(f) == "", F.lit(f"{f} is required")) for f in ("source_system", "release_scope", "horizon_rule")]
    named = F.array_sort(F.map_keys("counts_by_split"))
    checks.append(F.when(named != F.array(*map(F.lit, sorted(splits))), F.lit("counts must have the canonical splits")))
    for split in splits:
        counts = F.col("counts_by_split")[split]
        checks += [F.when(counts.isNull() | ~F.array_contains(F.map_keys(counts), c), F.lit(f"missing count for {split}:{c}")) for c in classes]
    return F.coalesce(*checks)
