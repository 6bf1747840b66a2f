"""Values of the queries that have no SQL, against plain computations over the same tables."""

import math

import numpy as np
import pytest

from gaugeworks.operators import models as ML
from gaugeworks.plans.scoring import projection
from gaugeworks.registry import queries

from .conftest import SMALL

Q = queries()


def test_no_query_is_left_out():
    from gaugeworks.registry import oracle_sql

    assert set(Q) - set(oracle_sql()) == {"a_distinct_approx", "a_paired", "fn_proj", "g_stage1", "ml_logit", "ml_gbt", "ml_ridge"}


def test_distinct_approx(spark):
    exact, near = Q["a_distinct"](spark, SMALL).first(), Q["a_distinct_approx"](spark, SMALL).first()
    assert all(near[c] == pytest.approx(exact[c], rel=0.08) for c in ("orders", "parts", "days"))


def test_paired(spark, duck):
    r = Q["a_paired"](spark, SMALL).first()
    rows = duck.sql("SELECT round(1.0::double / 3 + (l_linenumber - 4) * 0.001::double, 9) AS a, round(l_discount * 5, 9) AS b, (l_returnflag = 'R')::int AS y FROM lineitem").df()
    a, b = ((rows[c] - rows["y"]) ** 2 for c in "ab")
    d = (b - a)[(b - a).abs() > 0]
    ranks = d.abs().round(12).rank()
    low = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    assert (r["n"], r["pairs"]) == (len(rows), len(d)) and r["statistic"] == pytest.approx(low, rel=1e-6)
    assert (r["candidate_brier"], r["baseline_brier"]) == pytest.approx((a.mean(), b.mean()))
    ties = (ranks.groupby(ranks).size() ** 3 - ranks.groupby(ranks).size()).sum()
    n = len(d)
    z = (low - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    assert abs(r["z"]) == pytest.approx(abs(z), rel=1e-3) and r["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-6)


def test_projection(spark):
    got = {r["vec_id"]: [r[f"p{k}"] for k in range(8)] for r in Q["fn_proj"](spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert len(got) == len(rows)
    for r in rows[:40]:
        v = np.array(r["embedding"], float)
        assert got[r["vec_id"]] == pytest.approx((np.array(projection(len(v), 8)) @ v).round(6).tolist(), abs=2e-6)


def test_logistic(spark, duck):
    got = {r["family"]: r for r in Q["ml_logit"](spark, SMALL).collect()}
    n, y, p = duck.sql("SELECT count(*), sum((o_orderstatus = 'F')::int), (SELECT avg((o_orderstatus = 'F')::int) FROM orders WHERE o_orderkey % 4 <> 0) FROM orders WHERE o_orderkey % 4 = 0").fetchall()[0]
    assert got["prior"]["n"] == got["logistic"]["n"] == n and got["prior"]["brier"] == pytest.approx((y * (1 - p) ** 2 + (n - y) * p**2) / n, abs=1e-4) and got["prior"]["auc"] == 0.5
    assert abs(got["logistic"]["brier"] - got["prior"]["brier"]) < 0.02
    rng = np.random.default_rng(1)
    rows = [(float(x) if i % 9 else None, "ab"[i % 2], float(rng.random() < 1 / (1 + math.exp(-3 * x - (2 if i % 2 else -2))))) for i, x in enumerate(rng.normal(size=1500))]
    df = spark.createDataFrame(rows, "x double, c string, y double")
    done = ML.probability(ML.logistic_baseline(df, ["x"], ["c"]), df).select("x", "c", "y", "s").toPandas()
    assert ((done.s > 0.5) == (done.y > 0.5)).mean() > 0.85 and ((done.s - done.y) ** 2).mean() < 0.12
    # The chance of a value between two others is between theirs.
    one = done[(done.c == "a") & done.x.notna()].sort_values("x").s.to_numpy()
    assert (np.diff(one) >= -1e-9).all()


def test_boosted(spark, duck):
    got = Q["ml_gbt"](spark, SMALL).first()
    n, mae = duck.sql("""WITH r AS (SELECT max(l_linenumber) OVER (PARTITION BY l_orderkey) - l_linenumber AS y, l_orderkey % 5 = 0 AS test FROM lineitem)
      SELECT count(*), avg(abs(y - (SELECT quantile_cont(y, 0.5) FROM r WHERE NOT test))) FROM r WHERE test""").fetchall()[0]
    assert got["n"] == n and got["median_mae"] == pytest.approx(mae, abs=1e-4) and got["model_mae"] < got["median_mae"]


def test_ridge(spark):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(60, 4)), rng.normal(size=(4, 3))
    t = x @ w + 0.5 + 0.01 * rng.normal(size=(60, 3))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, t)], "x array<double>, t array<double>").repartition(5)
    one = np.column_stack([x, np.ones(60)])
    got = ML.ridge(df, "x", "t", penalty=1.0)
    kept = [np.linalg.solve(one.T @ one + np.diag(d), one.T @ t) for d in ([1.0] * 5, [1.0] * 4 + [0.0])]
    assert got.shape == (5, 3) and any(np.allclose(got, k) for k in kept)
    rows = {r["vec_id"]: r["anomaly"] for r in Q["ml_ridge"](spark, SMALL).collect()}
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    v = np.array([r["embedding"] for r in e], float)
    half = v.shape[1] // 2
    pre, post = spark.createDataFrame([(r[:half].tolist(), r[half:].tolist()) for r in v], "a array<double>, b array<double>"), v[:, half:]
    error = ((np.column_stack([v[:, :half], np.ones(len(v))]) @ ML.ridge(pre, "a", "b") - post) ** 2).sum(axis=1)
    want = error / (error + error.mean())
    assert [rows[r["vec_id"]] for r in e] == pytest.approx(want.tolist(), abs=2e-6)


def test_stage1(spark, duck):
    from gaugeworks.plans.bindings import CORPUS

    rows = duck.sql(f"""WITH {CORPUS} SELECT row_id, split, s, (outcome = 'observed_positive')::int AS y FROM corpus
      WHERE outcome <> 'censored' AND linked AND NOT late_field AND NOT foreign_field""").df()
    from gaugeworks.plans.bindings import corpus
    from gaugeworks.plans.gates import admission_failures

    bad = {r["row_id"] for r in admission_failures(corpus(spark, SMALL)).where("gate IN ('lineage_linkage', 'outcome_censoring', 'prediction_time_fields')").collect()}
    rows = rows[~rows.row_id.isin(bad)]
    fit, test = rows[rows.split == "calibration_fit"], rows[rows.split == "test"].copy()
    per = fit.groupby("s").y.agg(["size", "sum"])
    lo, hi, w, t = ML.pooled(*(np.array(c, float) for c in (per.index, per.index, per["size"], per["sum"])))
    points = np.array([(x, m) for a, b, m in zip(lo, hi, t / w) for x in dict.fromkeys((a, b))])
    test["c"] = np.interp(test.s, points[:, 0], points[:, 1]).clip(0, 1)
    for r in Q["g_stage1"](spark, SMALL).collect():
        mine = test[test.row_id % 2 == int(r["family"][-1])]
        assert (r["n"], r["positives"]) == (len(mine), mine.y.sum()) and r["brier"] == pytest.approx(((mine.c - mine.y) ** 2).mean(), abs=2e-6)
        pos, neg = mine[mine.y == 1].c.to_numpy()[:, None], mine[mine.y == 0].c.to_numpy()[None]
        assert r["auc"] == pytest.approx(((pos > neg) + 0.5 * (pos == neg)).mean(), abs=2e-6)
