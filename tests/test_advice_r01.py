"""The whole jobs of review round 1."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeworks import registry
from gaugeworks.operators import metrics as M
from gaugeworks.plans import resampling as R
from gaugeworks.plans.knowledge import anchors, covered
from gaugeworks.streaming import feeds

from .conftest import SMALL


def test_resamples_draw_all_rows_and_measure_as_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.randrange(40) / 40, rnd.randrange(2)) for _ in range(700)]
    w = R.resamples(spark.createDataFrame(rows, "s double, y int"), 6).cache()
    got = {r["replicate"]: r for r in R.resampled_metrics(w).collect()}
    drawn = w.collect()
    assert sorted(got) == list(range(6)) and {(r["s"], r["y"]) for r in drawn} <= set(rows)
    for k, r in got.items():
        own = [(x["s"], x["y"], x["w"]) for x in drawn if x["replicate"] == k]
        n = sum(c for *_, c in own)
        pos, neg = [(s, c) for s, y, c in own if y], [(s, c) for s, y, c in own if not y]
        wins = sum(a * b * ((p > q) + 0.5 * (p == q)) for p, a in pos for q, b in neg)
        assert n == 700 and r["rate"] == pytest.approx(sum(c for _, c in pos) / n)
        assert r["auc"] == pytest.approx(wins / (sum(c for _, c in pos) * sum(c for _, c in neg)))
        assert r["brier"] == pytest.approx(sum(c * (s - y) ** 2 for s, y, c in own) / n)


def test_bootstrap_narrows_with_rows_and_skips_one_class(spark):
    make = lambda n: spark.createDataFrame([((i * 7 % 100) / 100, int(i % 2)) for i in range(n)], "s double, y int")
    few, many = (R.bootstrap_metrics(make(n), 200).first() for n in (100, 6400))
    assert (many["rate_high"] - many["rate_low"]) < (few["rate_high"] - few["rate_low"]) / 4
    assert few["usable"] == 200 and few["ece_low"] < few["ece_high"] and few["auc_low"] < few["auc_high"]
    one = R.bootstrap_metrics(spark.createDataFrame([(i / 10, int(i == 0)) for i in range(8)], "s double, y int")).first()
    assert one["replicates"] == 500 and 250 < one["usable"] < 400


def test_bootstrap_yield_has_a_status(spark):
    make = lambda t: spark.createDataFrame([(c,) for c in t], "c string")
    r = R.bootstrap_yield(make("p" * 300 + "q" * 600 + "z" * 100)).first()
    assert r["replicates"] == 2000 and r["status"] == "estimable" and r["implied"] == 167 and r["implied_low"] > 167
    assert 0.26 < r["positive_low"] < 0.3 < r["positive_high"] < 0.34
    assert [R.bootstrap_yield(make(t)).first()["status"] for t in ("qz", "pz", "zz")] == ["no_positive_events", "no_negative_events", "no_labeled_events"]


def test_paired_verdict(spark):
    kind = "a double, b double, y int"
    same = M.paired_comparison(spark.createDataFrame([(0.5, 0.5, 1)] * 4, kind)).first()
    assert (same["statistic"], same["p_value"], same["verdict"]) == (0.0, 1.0, "no significant difference")
    better = [(0.9 - i / 1000, 0.5, 1) for i in range(10)]
    r = M.paired_comparison(spark.createDataFrame(better, kind)).first()
    assert r["p_value"] == pytest.approx(2 / 2**10) and r["verdict"].startswith("candidate significantly better")
    r = M.paired_comparison(spark.createDataFrame([(b, a, y) for a, b, y in better], kind)).first()
    assert r["verdict"] == "candidate significantly worse"


def hourly(df):
    return {(r["hour"], r["n"]) for r in df.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.count("*").alias("n")).collect()}


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """The smallest events in 20 files in no order."""
    to = tmp_path_factory.mktemp("shuffled")
    spark.read.parquet(f"{SMALL}/events.parquet").repartition(20, F.xxhash64("event_id")).write.parquet(f"{to}/events.parquet")
    return str(to)


def test_streams_lose_nothing_of_shuffled_files(spark, shuffled):
    e, q = spark.read.parquet(f"{shuffled}/events.parquet").cache(), registry.queries()
    n = e.count()
    assert q["st_ingest"](spark, shuffled).agg(F.count("*"), F.count_distinct("event_id")).first() == (n, n)
    assert q["st_pairs"](spark, shuffled).count() == e.where("event_id % 3 = 0").count()
    assert {(r["hour"], r["n"]) for r in q["st_hourly"](spark, shuffled).collect()} == hourly(e)
    want = {tuple(r) for r in covered(spark, shuffled).groupBy("anchor").agg(F.count("*")).collect()}
    got = {(r["anchor"], r["n"]) for r in q["st_interval"](spark, shuffled).collect()}
    assert {(a, n) for a, n in got if n} == want and len(got) == anchors(spark, shuffled).count()
    want = {tuple(r) for r in e.groupBy("user_id").agg(F.count("*") - 1, F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).collect() if r[1]}
    assert {tuple(r) for r in q["st_gaps"](spark, shuffled).collect()} == want


def test_replay_over_many_triggers(spark, shuffled):
    e = spark.read.parquet(f"{shuffled}/events.parquet")
    got = feeds.run_to_table(feeds.hourly_means(feeds.replay(e, "2 hours", files=20)), "hourly")
    assert {(r["hour"], r["n"]) for r in got.collect()} == hourly(e)
    assert feeds.run_to_table(feeds.ingest(feeds.replay(e, files=20)), "ingest").count() == e.count()
