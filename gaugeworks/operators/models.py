"""Models fitted on Spark: isotonic calibration, logistic and boosted baselines, and a ridge predictor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clamp
from ..sources.store import scratch
from .order import in_order


def fit_isotonic(df: DataFrame, score: str = "s", label: str = "y") -> list[tuple[float, float]]:
    """Boundaries and predictions of an isotonic fit; empty (pass-through) when a class is missing.

    Equal scores are one weighted row first, so the fit sees distinct scores."""
    per = df.groupBy(F.col(score).alias("features")).agg(F.avg(F.col(label).cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))
    if per.agg(F.sum(F.col("label") * F.col("weight")).alias("p"), F.sum("weight").alias("n")).where("p > 0 AND p < n").count() == 0:
        return []
    model = IsotonicRegression(weightCol="weight").fit(per)
    return list(zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist(), strict=True))


def calibrated(score: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between the boundaries and constant outside, as one expression; the score itself without a fit."""
    if not points:
        return clamp(score)
    xs, ys = (F.array(*(F.lit(float(p[k])) for p in points)) for k in (0, 1))
    at = F.size(F.filter(xs, lambda x: x <= score))
    x0, x1, y0, y1 = F.get(xs, at - 1), F.get(xs, at), F.get(ys, at - 1), F.get(ys, at)
    inside = F.when(x1 == x0, y1).otherwise(y0 + (y1 - y0) * (score - x0) / (x1 - x0))
    return clamp(F.when(score.isNull(), None).when(at == 0, points[0][1]).when(at == len(points), points[-1][1]).otherwise(inside))


#: Blocks that applying a fit holds in a task's memory, two numbers each; larger fits are applied by a sorted merge.
MOST_BLOCKS = 1_000_000


def pooled(lo: np.ndarray, hi: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pool adjacent violators over weighted blocks in order of lo: means ascend in what is left."""
    at: list[list[float]] = []
    for block in zip(lo.tolist(), hi.tolist(), weight.tolist(), total.tolist(), strict=True):
        at.append(list(block))
        # Equal means are pooled as well, so that blocks are the same however the rows were cut into ranges.
        while len(at) > 1 and at[-2][3] * at[-1][2] >= at[-1][3] * at[-2][2]:
            _, high, w, t = at.pop()
            at[-1][1:] = [high, at[-1][2] + w, at[-1][3] + t]
    return tuple(np.array([b[k] for b in at], dtype=float) for k in range(4))


def isotonic_blocks(df: DataFrame, score: str = "s", label: str = "y") -> DataFrame:
    """A fit as a written table of blocks (lo, hi, weight, total): total / weight is the fitted value from lo to hi. No
    row where a class is missing.

    Ranges of scores are pooled by themselves. As long as the means of neighbouring ranges go back where they meet, such
    neighbours are put together and pooled again: a block of blocks is pooled as its rows would be, in any grouping."""
    spark = df.sparkSession
    per = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("lo")).agg(F.count("*").cast("double").alias("weight"), F.sum(F.col(label).cast("double")).alias("total"))
    rows = in_order(per.withColumn("hi", F.col("lo")), "lo")
    kind = "part long, lo double, hi double, weight double, total double"

    def pool(key, part):
        part = part.sort_by("lo")
        done = pooled(*(part[c].to_numpy() for c in ("lo", "hi", "weight", "total")))
        return pa.table([pa.array([key[0].as_py()] * len(done[0]), pa.int64()), *map(pa.array, done)], ["part", "lo", "hi", "weight", "total"])

    def pooled_by(blocks: DataFrame) -> DataFrame:
        path = scratch(spark, "blocks")
        blocks.groupBy("part").applyInArrow(pool, kind).write.parquet(path)
        return spark.read.schema(kind).parquet(path)

    blocks = pooled_by(rows.withColumnRenamed("_range", "part").drop("_at"))
    while True:
        mean = F.col("total") / F.col("weight")
        ends = blocks.groupBy("part").agg(F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"), F.min("lo").alias("lo"))
        order = Window.orderBy("lo")
        back = F.coalesce(F.lag("last").over(order) >= F.col("first"), F.lit(False))
        chains = ends.withColumn("back", back).withColumn("chain", F.sum((~F.col("back")).cast("long")).over(order)).select("part", "chain", "back")
        if not chains.agg(F.coalesce(F.bool_or("back"), F.lit(False))).first()[0]:
            break
        blocks = pooled_by(blocks.join(chains.select("part", "chain"), "part").drop("part").withColumnRenamed("chain", "part"))
    both = blocks.agg(F.sum("total").alias("p"), F.sum("weight").alias("n")).where("p > 0 AND p < n").count()
    return blocks.drop("part").where(F.lit(bool(both)))


def apply_isotonic(df: DataFrame, blocks: DataFrame, score: str = "s", to: str = "calibrated") -> DataFrame:
    """Adds the fitted value: linear between the blocks' ends, constant outside, null for a null score; the clamped score
    itself without a fit. A search in the sorted ends for each row, in tasks that hold them; above MOST_BLOCKS, a merge."""
    mean = (F.col("total") / F.col("weight")).alias("y")
    ends = blocks.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"), mean)
    n = blocks.count()
    if not n:
        return df.withColumn(to, F.when(F.col(score).isNotNull(), clamp(F.col(score))))
    if n > MOST_BLOCKS:
        return merged_isotonic(df, ends, score, to)
    points = ends.toArrow().sort_by("x")
    shared = df.sparkSession.sparkContext.broadcast((points["x"].to_numpy(), points["y"].to_numpy()))

    @F.arrow_udf("double")
    def fitted(s: pa.Array) -> pa.Array:
        return pa.array(np.interp(s.to_numpy(zero_copy_only=False), *shared.value), mask=np.asarray(s.is_null()))

    return df.withColumn(to, F.when(F.col(score).isNotNull(), clamp(fitted(F.col(score).cast("double")))))


def merged_isotonic(df: DataFrame, ends: DataFrame, score: str, to: str) -> DataFrame:
    """The same by order: rows and ends sorted together in ranges, each row between the last end before it and the next."""
    row, end = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.struct("x", "y").alias("_end")
    kind = dict(df.select(row).dtypes)["_row"]
    scored = df.select(F.col(score).cast("double").alias("_s"), F.lit(None).cast("struct<x:double,y:double>").alias("_end"), row)
    both = in_order(ends.select(F.col("x").alias("_s"), end, F.lit(None).cast(kind).alias("_row")).unionAll(scored), F.asc_nulls_first("_s"), F.col("_end").isNull())
    inside = Window.partitionBy("_range").orderBy("_at")
    there = F.col("_end").isNotNull()
    per = both.groupBy("_range").agg(F.max_by("_end", F.when(there, F.col("_at"))).alias("_l"), F.min_by("_end", F.when(there, F.col("_at"))).alias("_f"))
    over = Window.orderBy("_range")
    per = per.select("_range", F.last("_l", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_l"), F.first("_f", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_f"))
    lower = F.coalesce(F.last("_end", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_l"))
    upper = F.coalesce(F.first("_end", True).over(inside.rowsBetween(0, Window.unboundedFollowing)), F.col("_f"))
    near = both.join(per, "_range").withColumn("_a", lower).withColumn("_b", upper).where("_row IS NOT NULL")
    a, b, s = F.col("_a"), F.col("_b"), F.col("_s")
    line = a["y"] + (b["y"] - a["y"]) * (s - a["x"]) / (b["x"] - a["x"])
    value = F.when(a.isNull(), b["y"]).when(b.isNull() | (a["x"] == b["x"]), a["y"]).otherwise(line)
    return near.select("_row.*", F.when(s.isNotNull(), clamp(value)).alias(to))


def logistic_baseline(train: DataFrame, numbers: list[str], categories: list[str], label: str = "y"):
    """Median imputation, standardisation, one-hot categories and logistic regression."""
    filled = [f"{n}_filled" for n in numbers]
    stages = [Imputer(inputCols=numbers, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)]
    stages += [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in categories]
    stages += [OneHotEncoder(inputCols=[f"{c}_index" for c in categories], outputCols=[f"{c}_hot" for c in categories], handleInvalid="keep")]
    stages += [VectorAssembler(inputCols=["scaled", *(f"{c}_hot" for c in categories)], outputCol="features"), LogisticRegression(labelCol=label, maxIter=30, regParam=1e-3)]
    return Pipeline(stages=stages).fit(train)


def probability(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("s", vector_to_array("probability")[1])


def boosted_regressor(train: DataFrame, numbers: list[str], label: str = "y"):
    return Pipeline(stages=[VectorAssembler(inputCols=numbers, outputCol="features", handleInvalid="skip"), GBTRegressor(labelCol=label, maxIter=10, maxDepth=3, seed=7)]).fit(train)


def ridge(df: DataFrame, features: str, target: str, penalty: float = 1.0) -> np.ndarray:
    """Weights (features + 1 x targets) of a ridge predictor between two array columns of fixed length.

    Each task sums the outer products of its rows, and Spark the tasks' sums; only the small system reaches the driver.
    Rows with a null or non-finite component are left out."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            pairs = [(x, t) for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if None not in x and None not in t]
            if pairs:
                x = np.column_stack([np.array([p[0] for p in pairs], float), np.ones(len(pairs))])
                z = np.column_stack([x, np.array([p[1] for p in pairs], float)])
                fine = np.isfinite(z).all(axis=1)
                part = x[fine].T @ z[fine]
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])

    rows = df.where(F.col(features).isNotNull() & F.col(target).isNotNull()).select(F.col(features).cast("array<double>"), F.col(target).cast("array<double>"))
    summed = rows.mapInArrow(sums, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    n = max((r["i"] for r in summed), default=-1) + 1
    m = np.zeros((n, max((r["j"] for r in summed), default=-1) + 1))
    for r in summed:
        m[r["i"], r["j"]] = r["v"]
    keep = penalty * np.eye(n)
    if n:
        keep[-1, -1] = 0
    return np.linalg.solve(m[:, :n] + keep, m[:, n:]) if n else m


def predicted(features: Column, weights: np.ndarray) -> Column:
    x = F.concat(features.cast("array<double>"), F.array(F.lit(1.0)))
    dot = lambda w: F.aggregate(F.zip_with(x, F.array(*map(F.lit, w.tolist())), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return F.array(*(dot(weights[:, k]) for k in range(weights.shape[1])))
