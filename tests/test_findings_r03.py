"""Findings of round 3: work that grows no faster than the tables, with the same rows."""

import datetime as dt
import glob
import math
import os
import random
import time

from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from gaugeworks.operators import intervals as I
from gaugeworks.plans import resampling as R
from gaugeworks.sources import store as S
from gaugeworks.streaming import feeds

from .conftest import SMALL, rows


def test_large_draws_are_arrays(spark):
    n = 4_000_000
    df = spark.range(20_000, numPartitions=4).select(F.lit(n).alias("n"), R.uniform(0, F.col("id")).alias("u"))
    began = time.time()
    mean, spread = df.select(R.binomial(F.col("n"), F.lit(1), F.lit(2), F.col("u")).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert time.time() - began < 60
    sigma = math.sqrt(n) / 2
    assert abs(mean - n / 2) < 5 * sigma / math.sqrt(20_000) and 0.97 < spread / sigma < 1.03


def test_pieces_of_intervals(spark):
    rnd = random.Random(5)
    spans = [(k, a := rnd.choice([rnd.randrange(1 << rnd.randrange(1, 45)), 64 ** rnd.randrange(7)]), a + rnd.choice([-1, 0, rnd.randrange(1 << rnd.randrange(1, 42))])) for k in range(300)]
    at = sorted({max(0, x + rnd.choice([-1, 0, 1, 63])) for _, lo, hi in spans for x in (lo, hi, (lo + hi) // 2)})
    rows, intervals = spark.createDataFrame([(x,) for x in at], "_at long"), spark.createDataFrame(spans, "key long, lo long, hi long")
    want = {k: n for k, lo, hi in spans if (n := sum(lo <= x <= hi for x in at))}
    got = I.interval_sums(rows, intervals, "key", {"n": F.lit(1)}).collect()
    assert {r["key"]: r["n"] for r in got} == want
    assert {r["key"]: r["count"] for r in I.covered_rows(rows, intervals.where("hi - lo < 1000000000"), 1 << 24).groupBy("key").count().collect()} == {k: want[k] for k, lo, hi in spans if k in want and hi - lo < 1000000000}
    low = intervals.select("key", "lo", "hi", F.inline(I.pieces(F.col("lo"), F.col("hi"), 3))).where("bucket << (6 * level) < lo OR ((bucket + 1) << (6 * level)) - 1 > hi")
    assert low.count() == 0
    parts = intervals.select("key", "lo", "hi", F.explode(I.ends(F.col("lo"), F.col("hi"), 3)).alias("bucket"))
    inner = intervals.select("key", F.inline(I.pieces(F.col("lo"), F.col("hi"), 3))).join(rows.select(F.inline(I.buckets(F.col("_at"), 3))), ["level", "bucket"]).select("key")
    both = inner.unionAll(rows.withColumn("bucket", I.bucket(F.col("_at"), 3)).join(parts, "bucket").where("_at BETWEEN lo AND hi").select("key"))
    assert {r["key"]: r["count"] for r in both.groupBy("key").count().collect()} == want


def test_crowded_intervals_are_no_pairs(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    e = spark.range(40_000, numPartitions=4).select(F.col("id").alias("event_id"), (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") % 20_000) / 1000)).alias("ts"), (F.col("id") % 20_000 * 5).alias("user_id"), (F.col("id") % 7).cast("double").alias("value"), F.lit("view").alias("event_type"))
    e.unionAll(e.where("event_id % 20000 = 19999").select("event_id", (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("ts"), "user_id", "value", "event_type")).write.parquet(str(tmp_path / "events.parquet"))
    got = queries()["j_interval"](spark, str(tmp_path))
    assert "BETWEEN" not in got._jdf.queryExecution().toString().upper()
    # The last row is 6 hours and 19.999 s behind the start: in the interval of each user, whose first row is not later.
    assert got.groupBy("n", "mean").count().collect() and {(r["n"], r["mean"]) for r in got.collect()} == {(0, 0.0), (2, 0.5)}


def test_large_slots_are_not_written_again(spark, monkeypatch):
    monkeypatch.setattr(S, "BASE_BYTES", 0)
    store = S.EvidenceStore(spark, S.scratch(spark, "store"), slots=4)
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "event_id long, value double")
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{store.where('events')}/slot=*/**/*.parquet", recursive=True)}
    store.apply("events", rows(range(50), 1.0), "a=1")
    before = files()
    store.apply("events", rows(range(45, 60), 1.0), "a=2")
    assert before.items() <= files().items() and len(files()) > len(before)
    store.delete(f"{store.path}/_done/events/a=2")  # as after a lost driver
    store.apply("events", rows(range(45, 60), 1.0), "a=2")
    assert sorted(r["event_id"] for r in store.read("events").collect()) == list(range(60)) and store.get("events", 57).count() == 1
    assert {(r["action"], r["count"]) for r in store.apply("events", rows(range(60), 2.0), "a=3").groupBy("action").count().collect()} == {("conflict", 60)}


def test_among_keeps_all_wanted(spark):
    kept = S.among(spark.range(100_000), spark.range(0, 100_000, 100), ["id"])
    assert kept.where("id % 100 = 0").count() == 1000 and kept.count() < 1200


def test_triggers_commit_few_states(spark, duck, monkeypatch):
    at, key = [], "spark.sql.shuffle.partitions"
    monkeypatch.setattr(feeds, "scratch", lambda s, name: at.append(S.scratch(s, name)) or at[-1])
    usual = spark.conf.get(key)
    spark.conf.set(key, 200)
    try:
        got = queries()["st_pairs"](spark, SMALL).toPandas()
        assert spark.conf.get(key) == "200"
    finally:
        spark.conf.set(key, usual)
    assert rows(got) == rows(duck.sql(oracle_sql()["st_pairs"]).df())
    states = glob.glob(f"{at[-1].removeprefix('file:').replace('//', '/')}-state/state/0/[0-9]*")
    assert 0 < len(states) <= max(2 * spark.sparkContext.defaultParallelism, feeds.FILES_A_TRIGGER * feeds.FILE_ROWS // feeds.STATE_ROWS + 1)
    # A session with fewer partitions keeps them.
    assert feeds.state_partitions(spark) <= int(usual)
