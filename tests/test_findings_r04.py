"""Findings of round 4: work that grows no faster than the tables, with the same rows."""

import datetime as dt
import glob
import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from gaugeworks.operators import intervals as I
from gaugeworks.sources import store as S
from gaugeworks.streaming import feeds

KIND = "event_id long, user_id long, ts timestamp"
START = dt.datetime(2024, 1, 1)


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, feeds.ROCKS)
    yield
    spark.conf.set(key, before)


def stream_of(spark, files):
    path = S.scratch(spark, "feed")
    for k, rows in enumerate(files):
        time.sleep(1.1 if k else 0)
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(path)


def test_gaps_state_is_by_group(spark, rocks, monkeypatch):
    at = []
    monkeypatch.setattr(feeds, "scratch", lambda s, name: at.append(S.scratch(s, name)) or at[-1])
    n = 700
    rows = [(i, i % n, START + dt.timedelta(seconds=i)) for i in range(3 * n)]
    files = [rows[: 2 * n], rows[2 * n :], [(None, None, START + dt.timedelta(days=1))]]
    done = feeds.run_to_table(feeds.gaps(stream_of(spark, files)), "gaps")
    assert sorted(map(tuple, done.collect())) == sorted((u, n * 1_000_000) for u in range(n) for _ in range(2))
    states = spark.read.format("statestore").option("path", f"{at[-1]}-state").option("stateVarName", "last").load()
    assert 0 < states.count() <= 256 < n


@pytest.mark.parametrize("idle_hours", [None, 5])
def test_gaps_of_resources_in_one_group(spark, rocks, idle_hours):
    rnd = random.Random(11)
    rows = [(i, rnd.randrange(-20, 20) * (1 << 57), START + dt.timedelta(minutes=rnd.randrange(6000), microseconds=rnd.choice([0, 1, 999_999]))) for i in range(600)]
    rows += [(600 + k, u, t) for k, (_, u, t) in enumerate(rows[:40])]  # ties
    rows.sort(key=lambda r: (r[2] - START) // dt.timedelta(hours=25))
    files = [rows[k * 160 : (k + 1) * 160] for k in range(4)] + [[(None, None, START + dt.timedelta(days=30))]]
    for f in files[:-1]:
        rnd.shuffle(f)
    want, idle = [], dt.timedelta(hours=idle_hours or 10_000)
    for u in {r[1] for r in rows}:
        at = sorted(t for _, v, t in rows if v == u)
        want += [(u, (b - a) // dt.timedelta(microseconds=1)) for a, b in zip(at, at[1:]) if b - a <= idle]
    done = feeds.run_to_table(feeds.gaps(stream_of(spark, files), delay="26 hours", idle_hours=idle_hours, groups=1), "gaps")
    assert sorted(map(tuple, done.collect())) == sorted(want)


def test_margin_pairs_lie_in_runs(spark, tmp_path):
    i = F.col("id")
    at = (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.xxhash64("id") % 3600) + 3600)).alias("ts")
    e = spark.range(9_000, numPartitions=4).select(F.when(i % 997 != 0, i).alias("event_id"), F.when(i % 1009 != 0, at).alias("ts"), F.when(i % 887 != 0, i % 1500).alias("user_id"), F.lit("view").alias("event_type"), i.cast("double").alias("value"))
    e.unionAll(e.where("event_id < 50")).write.parquet(str(tmp_path / "events.parquet"))
    got = queries()["j_margin"](spark, str(tmp_path))
    got.write.parquet(out := str(tmp_path / "out"))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    con.sql(f"CREATE TABLE want AS {oracle_sql()['j_margin']}")
    con.sql(f"CREATE TABLE got AS SELECT anchor, event_id, inside FROM '{out}/*.parquet'")
    assert con.execute("(FROM want EXCEPT ALL FROM got) UNION ALL (FROM got EXCEPT ALL FROM want)").fetchall() == []
    n = con.execute("SELECT count(*) FROM got").fetchone()[0]
    assert n > 1_000_000 and sum(map(os.path.getsize, glob.glob(f"{out}/*.parquet"))) < 0.4 * n


def test_blocks_are_bounded(spark):
    df = spark.range(5_000, numPartitions=3).select((F.col("id") % 7 * F.col("id") % 2).alias("_step"), F.col("id").alias("_at"))
    blocks = I.in_blocks(df, "_rows", 6, 8, "_at")
    assert blocks.where("size(_rows) > 64").count() == 0 and blocks.count() < 5_000 / 64 + 3 * 8
    assert blocks.select("_step", F.inline("_rows")).exceptAll(df).isEmpty() and blocks.select(F.inline("_rows")).count() == 5_000
    held = spark.range(600).select(F.col("id").alias("key"), F.lit(0).alias("lo"), (F.col("id") - 1).alias("hi"))
    same = spark.range(1_100).select(F.col("id").alias("row"), F.lit(300).alias("_at"))
    assert I.covered_rows(same, held, 1_000).groupBy("key").count().agg(F.min("key"), F.count("*"), F.min("count"), F.max("count")).first() == (301, 299, 1_100, 1_100)
