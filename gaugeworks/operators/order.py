"""Order-dependent operators without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import scratch

#: Rows that a range holds on average, and the most ranges; beyond them ranges grow, and their sorts spill.
RANGE_ROWS, MOST_RANGES = 100_000, 50_000


def in_order(df: DataFrame, *order: str | Column) -> DataFrame:
    """df sorted by `order`, written in ranges, with _range and the place in it from 0, _at.

    Their number follows the rows' number, their bounds a sample of the data. A key that many rows share is split at what
    follows it in `order`, which should end with a unique key: no range holds a whole heavy key. Written, because a
    second run of the sort could set other bounds."""
    ranges = max(1, min(MOST_RANGES, -(-df.count() // RANGE_ROWS)))
    rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    path = scratch(df.sparkSession, "in_order")
    rows.write.parquet(path)
    place = F.lit((1 << 33) - 1)
    return df.sparkSession.read.parquet(path).select(*df.columns, F.shiftright("_id", 33).alias("_range"), F.col("_id").bitwiseAND(place).alias("_at"))


def before_ranges(rows: DataFrame, *values: Column) -> DataFrame:
    """A row a range: _range, its rows _k, the rows of the ranges before it _before, and aggregates of its rows. All of
    them pass through one window, as many as there are ranges."""
    per = rows.groupBy("_range").agg(F.count("*").alias("_k"), *values)
    return per.withColumn("_before", F.coalesce(F.sum("_k").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def placed(df: DataFrame, *order: str | Column, to: str = "pos") -> DataFrame:
    """Adds each row's place in the order, from 1."""
    rows = in_order(df, *order)
    offsets = before_ranges(rows).select("_range", "_before")
    return rows.join(offsets, "_range").select(*df.columns, (F.col("_before") + F.col("_at") + 1).alias(to))


def adjacent_gaps(df: DataFrame, order: str, value: str) -> DataFrame:
    """(value, before): each row's value and the one before it in the order of a unique key.

    A range's first row gets the last value of the range before, from a table with one row a range."""
    rows = in_order(df.select(order, value), order)
    last = before_ranges(rows, F.max_by(value, "_at").alias("_last"))
    last = last.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_last"))
    inside = F.lag(value).over(Window.partitionBy("_range").orderBy("_at"))
    return rows.join(last, "_range").select(value, F.when(F.col("_at") == 0, F.col("_last")).otherwise(inside).alias("before"))


def split_at_fraction(df: DataFrame, order: str, tie: str, fraction: float, both: bool = False) -> DataFrame:
    """Adds train: whether a row is among the first floor(fraction n) by (order, tie); both: keep a row on each side."""
    rows = placed(df, *dict.fromkeys((order, tie)), to="_pos")
    n = df.count()
    cut = int(fraction * n)
    if both:
        cut = max(1, min(n - 1, cut))
    return rows.withColumn("train", F.col("_pos") <= cut).drop("_pos")


def first_by_score(df: DataFrame, want: float, ties: list[str], sums: dict[str, Column], groups: tuple[str, ...] = ()) -> DataFrame:
    """Sums over the first max(1, ceil(want n)) rows by (-s, *ties), by group, with n and selected of all groups.

    Counts by score say which score the cut falls on, and settle all scores above it. Only the rows of the cut's own
    score are ordered by their ties, in ranges: if most rows have that score, many tasks share it."""
    from .metrics import running

    spark = df.sparkSession
    path = scratch(spark, "by_score")
    df.groupBy("s", *groups).agg(F.count("*").alias("_k"), *(F.sum(c).alias(n) for n, c in sums.items())).write.parquet(path)
    per = spark.read.parquet(path)
    n = per.agg(F.coalesce(F.sum("_k"), F.lit(0))).first()[0]
    selected = max(1, -int(-want * n // 1))
    above = running(per.groupBy("s").agg(F.sum("_k").alias("k")), [], "s", ["k"], ascending=False)
    at = above.where((F.col("k_before") < selected) & (F.col("k_before") + F.col("k") >= selected)).first()
    if at is None:
        return per.groupBy(*groups).agg(*(F.sum(c).alias(c) for c in sums)).withColumns({"n": F.lit(n), "selected": F.lit(selected)})
    sure = per.where(F.col("s") > at["s"]).select(*groups, *sums)
    edge = df.where(F.col("s") == at["s"]).select(*groups, *dict.fromkeys(t for t in ties if t not in groups), *(c.alias(k) for k, c in sums.items()))
    edge = placed(edge, *ties, to="_pos").where(F.col("_pos") <= selected - at["k_before"]).select(*groups, *sums)
    return sure.unionByName(edge).groupBy(*groups).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums)).withColumns({"n": F.lit(n), "selected": F.lit(selected)})


def at_ranks(df: DataFrame, groups: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """For each group the values at some places from 0 in its order, as columns; ranks are expressions of n, its rows.

    Exact, from counts by value: ranges of (group, value) are summed, then the places are looked up in their range. No
    task sorts or buffers a group."""
    per = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    rows = in_order(per, *groups, value)
    both = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*groups, "_range").agg(F.sum("_n").alias("_part"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_part").over(both), F.lit(0))).withColumn("n", F.sum("_part").over(Window.partitionBy(*groups)))
    wanted = parts.select(*groups, "_range", "_before", "_part", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), c.cast("long").alias("rank")) for k, c in ranks.items()))).alias("w")).select("*", "w.*")
    wanted = wanted.where((F.col("_before") <= F.col("rank")) & (F.col("rank") < F.col("_before") + F.col("_part")))
    inside = F.sum("_n").over(Window.partitionBy("_range", *groups).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    counted = rows.join(wanted.select(*groups, "_range").distinct(), [*groups, "_range"]).withColumn("_upto", inside)
    found = counted.join(wanted, [*groups, "_range"]).where((F.col("_before") + F.col("_upto") > F.col("rank")) & (F.col("_before") + F.col("_upto") - F.col("_n") <= F.col("rank")))
    return found.groupBy(*groups).agg(*(F.max(F.when(F.col("name") == k, F.col(value))).alias(k) for k in ranks))
