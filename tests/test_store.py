"""The evidence store: repeated and half-finished batches, conflicts, references between tables, and the streaming sink."""

import os
import time

import pytest
from pyspark.sql import functions as F

from gaugeworks.sources.store import EvidenceStore, scratch
from gaugeworks.streaming import feeds

KIND = "event_id long, family string, value double"


@pytest.fixture()
def store(spark):
    return EvidenceStore(spark, scratch(spark, "store"), slots=8)


def events(spark, *rows):
    return spark.createDataFrame([(i, "change", float(v)) for i, v in rows], KIND)


def held(store):
    return {r["event_id"]: r["value"] for r in store.read("events").collect()}


def actions(plan):
    return {(r["event_id"], r["value"]): (r["action"], r["times"]) for r in plan.collect()}


def files(store):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(store.where("events")) for f in names if f.endswith(".parquet") and "slot=" in d}


def test_retries_and_conflicts(spark, store):
    store.apply("events", events(spark, (1, 1), (2, 2), (2, 2), (3, 3)), "a")
    plan = store.apply("events", events(spark, (1, 1), (2, 9), (4, 4), (5, 5), (5, 6)), "b")
    got = actions(plan)
    assert got[1, 1.0][0] == "same" and got[2, 9.0][0] == "conflict" and got[4, 4.0] == ("insert", 1)
    assert sorted(got[5, v][0] for v in (5.0, 6.0)) == ["conflict", "insert"]
    five = 5.0 if got[5, 5.0][0] == "insert" else 6.0
    want = {1: 1.0, 2: 2.0, 3: 3.0, 4: 4.0, 5: five}
    assert held(store) == want
    before = files(store)
    assert actions(store.apply("events", events(spark, (9, 9)), "b")) == got and held(store) == want
    assert {a for a, _ in actions(store.apply("events", events(spark, (1, 1), (2, 2)), "c")).values()} == {"same"}
    assert files(store) == before


def test_untouched_slots_keep_their_files(spark, store):
    store.apply("events", events(spark, *((i, i) for i in range(200))), "a")
    before = files(store)
    time.sleep(0.01)
    store.apply("events", events(spark, (1000, 1)), "b")
    after = files(store)
    slot = {f.split("slot=")[1].split("/")[0] for f in after.keys() - before.keys()}
    assert len(slot) == 1 and {f for f, t in before.items() if after.get(f) != t} == {f for f in before if f.split("slot=")[1].split("/")[0] in slot}
    assert len(held(store)) == 201 and store.get("events", 1000).first()["value"] == 1.0
    assert "PartitionFilters: [isnotnull(slot" in store.get("events", 7)._jdf.queryExecution().toString()


def test_a_lost_driver_leaves_nothing_half_done(spark, store, monkeypatch):
    store.apply("events", events(spark, (1, 1), (2, 2)), "a")

    def lost(*_):
        raise RuntimeError("lost")

    batch = events(spark, (2, 9), (3, 3), (4, 4))
    with monkeypatch.context() as m:
        m.setattr(EvidenceStore, "insert", lost)
        with pytest.raises(RuntimeError):
            store.apply("events", batch, "b")
    assert held(store) == {1: 1.0, 2: 2.0}
    with monkeypatch.context() as m:  # the tables are staged, and lost before they are in place
        m.setattr(EvidenceStore, "delete", lost)
        with pytest.raises(RuntimeError):
            store.apply("events", batch, "b")
    plan = store.apply("events", events(spark), "b")
    assert held(store) == {1: 1.0, 2: 2.0, 3: 3.0, 4: 4.0}
    assert sorted(a for a, _ in actions(plan).values()) == ["conflict", "insert", "insert"]


def test_order_inside_a_batch_and_odd_rows(spark, store):
    rows = [(1, 5.0, 2), (1, 4.0, 1), (None, 1.0, 1), (2, None, 1)]
    plan = store.apply("events", spark.createDataFrame(rows, "event_id long, value double, sent int"), "a", order="sent")
    assert {(r["event_id"], r["value"]): (r["action"], r["reason"]) for r in plan.collect()} == {(1, 4.0): ("insert", None), (1, 5.0): ("conflict", None), (None, 1.0): ("rejected", "the key is missing"), (2, None): ("insert", None)}
    assert held(store) == {1: 4.0, 2: None}
    assert store.apply("events", spark.createDataFrame([], "event_id long, value double, sent int"), "b", order="sent").count() == 0


def test_signals_and_outcomes_refer_to_what_is_stored(spark, store):
    def reasons(plan):
        return {tuple(r[k] for k in ("event_id", "strategy", "version")): r["reason"] or r["action"] for r in plan.collect()}

    kind = "event_id long, strategy long, version string, definition_id string"
    signal, outcome = f"{kind}, score double", f"{kind}, occurred boolean"
    assert reasons(store.apply("signals", spark.createDataFrame([(1, 1, "v1", "d", 0.5)], signal), "early")) == {(1, 1, "v1"): "unknown event"}
    store.apply("events", events(spark, (1, 1), (2, 2)), "a")
    store.apply("definitions", spark.createDataFrame([("d", "x")], "definition_id string, event string"), "a")
    rows = [(1, 1, "v1", "d", 0.5), (1, 1, "v2", "d", 0.6), (2, 1, "v1", "d", 0.1), (2, 2, "v1", "no", 0.2), (2, 3, "v1", "no", None), (3, 1, "v1", "d", 0.3)]
    assert reasons(store.apply("signals", spark.createDataFrame(rows, signal), "a")) == {(1, 1, "v1"): "insert", (1, 1, "v2"): "insert", (2, 1, "v1"): "insert", (2, 2, "v1"): "unknown definition", (2, 3, "v1"): "insert", (3, 1, "v1"): "unknown event"}
    rows = [(1, 1, None, "d", True), (1, 1, "v2", "d", True), (1, 1, "v3", "d", True), (2, 1, None, "d", False), (2, 3, "v1", "d", True), (9, 1, "v1", "d", True)]
    want = {(1, 1, None): "a version is required", (1, 1, "v2"): "insert", (1, 1, "v3"): "no such version", (2, 1, "v1"): "insert", (2, 3, "v1"): "another definition", (9, 1, "v1"): "no signal"}
    df = spark.createDataFrame(rows, outcome)
    assert reasons(store.apply("outcomes", df, "a")) == want and store.read("outcomes").count() == 2
    assert store.apply("outcomes", df, "b").where("action = 'insert'").count() == 0 and store.read("outcomes").count() == 2
    assert store.apply("outcomes", df.withColumn("occurred", ~F.col("occurred")), "c").where("action = 'insert'").count() == 2 and store.read("outcomes").count() == 4


def test_a_repeated_micro_batch_changes_nothing(spark, store):
    path = scratch(spark, "feed")
    kind = "event_id long, value double, sent int"
    for k, rows in enumerate([[(1, 1.0, 1), (2, 2.0, 1)], [(2, 2.0, 2), (1, 7.0, 2), (3, 3.0, 2)]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1 if not k else 0)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)
    state = scratch(spark, "state")
    feeds.run_into_store(stream, store, "events", "sent", state)
    ledger = sorted(map(str, store.ledger("events").collect()))
    feeds.forget_last_batch(spark, state)
    feeds.run_into_store(stream, store, "events", "sent", state)
    assert sorted(map(str, store.ledger("events").collect())) == ledger and held(store) == {1: 1.0, 2: 2.0, 3: 3.0}
    assert store.ledger("events").where("action = 'conflict'").select("event_id", "value").collect() == [(1, 7.0)]
