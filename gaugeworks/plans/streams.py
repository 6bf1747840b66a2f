"""Streams run to the end of the events table; the batch operators give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.store import EvidenceStore, scratch
from ..sources.tables import table
from ..streaming import feeds
from .knowledge import ANCHORS, anchors


def events(spark: SparkSession, sf_dir: str, closing: str | None = None) -> DataFrame:
    return feeds.replay(table(spark, sf_dir, "events"), closing)


@query("SELECT date_trunc('hour', ts) AS hour, round(avg(value), 6) AS mean, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1")
def st_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means in append mode; a closing row lets the last hours out too."""
    return feeds.run_to_table(feeds.hourly_means(events(spark, sf_dir, "2 hours")), "hourly").select(F.col("hour").cast("timestamp_ntz").alias("hour"), F.round("mean", 6).alias("mean"), "n")


@query(f"WITH {ANCHORS} SELECT anchor, count(event_id) AS n FROM anchors LEFT JOIN events ON ts BETWEEN start AND stop GROUP BY anchor")
def st_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per interval; intervals without rows stay, as in the batch query."""
    intervals = anchors(spark, sf_dir).select("anchor", F.col("start").cast("timestamp").alias("start"), F.col("stop").cast("timestamp").alias("stop"))
    counted = feeds.interval_totals(feeds.run_to_table(feeds.interval_counts(events(spark, sf_dir, "2 hours"), intervals), "intervals"), intervals)
    return anchors(spark, sf_dir).select("anchor").join(counted, "anchor", "left").select("anchor", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT event_id, user_id, value, 1::bigint AS inserted, (event_id % 7 = 0)::bigint AS same, (event_id % 11 = 0)::bigint AS conflicts FROM events")
def st_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed in which every seventh event is sent again an hour later and every eleventh with another value: the store
    has each as it first came, the ledger the rest. The last batch is run again, as after a lost driver."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.col("ts").alias("at"), "ts")
    late = e.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    feed = e.unionAll(late.where("event_id % 7 = 0")).unionAll(late.where("event_id % 11 = 0").withColumn("value", F.col("value") + 1))
    path = scratch(spark, "feed")
    store, state = EvidenceStore(spark, f"{path}/store", slots=16), f"{path}/state"
    stream = feeds.replay(feed)
    feeds.run_into_store(stream, store, "events", "ts", state)
    feeds.forget_last_batch(spark, state)
    feeds.run_into_store(stream, store, "events", "ts", state)
    count = lambda action, n: F.sum(F.when(F.col("action") == action, n).otherwise(0)).alias(action)
    ledger = store.ledger("events")
    per = ledger.groupBy("event_id").agg(count("insert", 1), (F.sum(F.when(F.col("action") == "same", F.col("times")).when(F.col("action") == "insert", F.col("times") - 1).otherwise(0))).alias("same"), count("conflict", F.col("times")))
    return store.read("events").join(per, "event_id").select("event_id", "user_id", "value", F.col("insert").cast("long").alias("inserted"), F.col("same").cast("long").alias("same"), F.col("conflict").cast("long").alias("conflicts"))


@query("SELECT event_id, round(least(value / 40, 1), 6) AS score, event_type = 'error' AS occurred FROM events WHERE event_id % 3 = 0")
def st_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = events(spark, sf_dir)
    signals = feed.withColumn("score", F.round(F.least(F.col("value") / 40, F.lit(1.0)), 6))
    outcomes = feed.where("event_id % 3 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 MINUTES")).withColumn("occurred", F.col("event_type") == "error")
    return feeds.run_to_table(feeds.pairs(signals, outcomes), "pairs")


@query("SELECT user_id, count(*) - 1 AS gaps, date_diff('microsecond', min(ts), max(ts)) AS span FROM events GROUP BY user_id HAVING count(*) > 1")
def st_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps per resource from keyed state; a closing row lets the last readings out."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, feeds.ROCKS)
    try:
        rows = feeds.run_to_table(feeds.gaps(events(spark, sf_dir, "2 hours")), "gaps")
    finally:
        spark.conf.set(key, before)
    return rows.groupBy("user_id").agg(F.count("*").alias("gaps"), F.sum("micros").alias("span"))
