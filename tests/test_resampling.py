"""Binomial draws and the tree of classes: exact distribution, whole replicates, the same draws on any partitioning."""

import math

import numpy as np
from pyspark.sql import functions as F

from gaugeworks.plans import resampling as R


def test_binomial_is_the_inverse_of_the_exact_distribution(spark):
    rows = [(n, a, b, u) for n, a, b in ((1, 1, 2), (7, 1, 3), (30, 2, 5), (200, 1, 100), (5000, 3, 7), (3, 0, 4), (3, 4, 4), (40, 39, 40)) for u in (1e-9, 0.02, 0.31, 0.5, 0.77, 0.99, 1 - 1e-9)]
    df = spark.createDataFrame(rows, "n long, a long, b long, u double")
    for r in df.withColumn("x", R.binomial(F.col("n"), F.col("a"), F.col("b"), F.col("u"))).collect():
        total, want, p = 0.0, 0, r["a"] / r["b"]
        for k in range(r["n"] + 1):
            if p in (0, 1):
                want = r["n"] * int(p)
                break
            total += math.exp(math.lgamma(r["n"] + 1) - math.lgamma(k + 1) - math.lgamma(r["n"] - k + 1) + k * math.log(p) + (r["n"] - k) * math.log(1 - p))
            if total >= r["u"]:
                want = k
                break
        assert r["x"] == want, r


def test_ln_factorial(spark):
    got = spark.range(0, 3000).select("id", R.ln_factorial(F.col("id")).alias("x")).collect()
    assert all(abs(r["x"] - math.lgamma(r["id"] + 1)) <= 1e-12 * max(1, r["x"]) for r in got)


def test_replicates_draw_all_rows_by_their_shares(spark):
    rng = np.random.default_rng(3)
    rows = [(round(float(s), 6), int(rng.random() < s)) for s in rng.choice(np.linspace(0, 1, 12), 300)] + [(1.0, 1), (0.0, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    done = R.resamples(df, 400).collect()
    size, seen = np.zeros(400), {}
    for r in done:
        size[r["replicate"]] += r["w"]
        seen.setdefault((r["s"], r["y"]), np.zeros(400))[r["replicate"]] += r["w"]
    assert (size == len(rows)).all()
    for key in set(rows):
        k, n = rows.count(key), len(rows)
        spread = math.sqrt(n * k / n * (1 - k / n))
        assert abs(seen[key].mean() - k) < 5 * spread / 20 and 0.85 < seen[key].std() / spread < 1.15
    joint = np.corrcoef(list(seen.values()))
    assert np.abs(joint[np.triu_indices(len(seen), 1)]).max() < 0.65
    again = R.resamples(df.repartition(7), 400).collect()
    assert sorted(map(str, done)) == sorted(map(str, again))


def test_no_rows(spark):
    empty = spark.createDataFrame([], "s double, y int")
    assert R.resamples(empty, 5).count() == 0
    assert R.bootstrap_yield(spark.createDataFrame([], "c string")).first()["status"] == "no_labeled_events"
