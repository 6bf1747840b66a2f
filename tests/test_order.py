"""Ranges that follow the data: order, places, selection and order statistics, with most rows tied; and isotonic fits."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import models as ML
from gaugeworks.operators import order as O


@pytest.fixture()
def small_ranges(monkeypatch):
    monkeypatch.setattr(O, "RANGE_ROWS", 100)


def test_ranges_are_even_where_one_key_holds_most_rows(spark, small_ranges):
    rnd = random.Random(4)
    rows = [(7 if rnd.random() < 0.9 else int(math.exp(rnd.random() * 20)), i) for i in range(4000)]
    ordered = O.in_order(spark.createDataFrame(rows, "k long, id long").repartition(6), "k", "id")
    sizes = [r["count"] for r in ordered.groupBy("_range").count().collect()]
    assert len(sizes) >= 30 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    got = [(r["k"], r["id"]) for r in ordered.orderBy("_range", "_at").collect()]
    assert got == sorted(rows)
    assert [(r["k"], r["id"]) for r in O.placed(spark.createDataFrame(rows, "k long, id long"), "k", "id").orderBy("pos").collect()] == sorted(rows)


@pytest.mark.parametrize("tied", [0.0, 0.9, 1.0])
def test_selection_splits_a_tied_score(spark, small_ranges, tied):
    rnd = random.Random(5)
    rows = [(i, 0.5 if rnd.random() < tied else round(rnd.random(), 3), rnd.randint(0, 1), rnd.choice("ab")) for i in range(1000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, s double, y int, family string")
    for share in (0.0001, 0.2, 0.55, 1.0):
        top = sorted(rows, key=lambda r: (-r[1], r[0]))[: max(1, math.ceil(share * 1000))]
        got = {r["family"]: (r["hits"], r["k"], r["selected"]) for r in O.first_by_score(df, share, ["id"], {"hits": F.col("y"), "k": F.lit(1)}, ("family",)).collect()}
        assert {f: got[f][:2] for f in got if got[f][1]} == {f: (sum(r[2] for r in top if r[3] == f), sum(r[3] == f for r in top)) for f in {r[3] for r in top}}
        assert all(g[2] == len(top) for g in got.values())
    assert O.first_by_score(df.limit(0), 0.2, ["id"], {"hits": F.col("y")}).first()["n"] == 0


def test_ranks_of_groups(spark, small_ranges):
    rnd = random.Random(6)
    rows = [(rnd.choice("aaaaaaab"), float(rnd.choice([1, 1, 1, 2, rnd.randint(0, 500)]))) for _ in range(3000)] + [("c", 4.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    n = F.col("n")
    got = {r["g"]: r.asDict() for r in O.at_ranks(df, ["g"], "v", {"low": n * 0, "fifth": F.floor(0.05 * (n - 1)), "mid": F.floor((n - 1) / 2), "high": n - 1}).collect()}
    for g in "abc":
        v = sorted(x for k, x in rows if k == g)
        assert got[g] == {"g": g, "low": v[0], "fifth": v[int(0.05 * (len(v) - 1))], "mid": v[(len(v) - 1) // 2], "high": v[-1]}
    assert "d" not in got


def sequential(rows):
    per = {}
    for s, y in rows:
        w, t = per.get(s, (0, 0))
        per[s] = (w + 1, t + y)
    xs = sorted(per)
    return ML.pooled(*(np.array(c, dtype=float) for c in (xs, xs, [per[x][0] for x in xs], [per[x][1] for x in xs])))


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "steps"])
def test_isotonic_blocks_equal_the_sequential_fit_on_any_ranges(spark, monkeypatch, shape):
    rnd = random.Random(7)
    chance = {"noise": lambda s: 0.5, "rising": lambda s: s, "falling": lambda s: 1 - s, "steps": lambda s: math.floor(s * 5) / 5}[shape]
    rows = [(s, int(rnd.random() < chance(s))) for s in (round(rnd.random(), 3) for _ in range(2500))]
    want = sequential(rows)
    df = spark.createDataFrame(rows, "s double, y int")
    for size in (10, 37, 10_000):
        monkeypatch.setattr(O, "RANGE_ROWS", size)
        got = ML.isotonic_blocks(df.repartition(3)).toArrow().sort_by("lo")
        assert all(np.allclose(got[c].to_numpy(), w) for c, w in zip(("lo", "hi", "weight", "total"), want, strict=True))
    points = ML.fit_isotonic(df)
    at = spark.createDataFrame([(None,), *((k / 50 - 0.1,) for k in range(61))], "s double").withColumn("kept", F.lit(1))
    blocks = ML.isotonic_blocks(df)
    plain = {r["s"]: r["c"] for r in at.select("s", ML.calibrated(F.col("s"), points).alias("c")).collect()}
    for most in (10**6, 0):
        monkeypatch.setattr(ML, "MOST_BLOCKS", most)
        monkeypatch.setattr(O, "RANGE_ROWS", 20)
        out = ML.apply_isotonic(at, blocks)
        assert out.columns == ["s", "kept", "calibrated"]
        got = {r["s"]: r["calibrated"] for r in out.collect()}
        assert got.pop(None) is None and len(got) == 61
        assert all(got[s] == pytest.approx(plain[s], abs=1e-9) for s in got)


def test_no_fit_without_both_classes(spark):
    for rows in ([], [(0.1, 1), (0.3, 1)], [(None, 1), (0.3, 0)]):
        blocks = ML.isotonic_blocks(spark.createDataFrame(rows, "s double, y int"))
        assert blocks.count() == 0
        assert ML.apply_isotonic(spark.createDataFrame([(1.5,)], "s double"), blocks).first()["calibrated"] == 1.0
