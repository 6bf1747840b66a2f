"""Each gate fails in one fixture, and passes where nothing is wrong."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators.definitions import FIELDS
from gaugeworks.plans import definitions as D
from gaugeworks.plans import evaluation as E
from gaugeworks.plans.bindings import SPLITS

KIND = (
    "row_id long, grp long, score_time timestamp_ntz, outcome string, split string, s double, window_complete boolean, monitored boolean, built boolean, linked boolean, late_field boolean, foreign_field boolean, "
    "horizon string, threshold_version string, censor_reason string, system string, evidence string, source_system string, private_data boolean, predeclared_at timestamp_ntz, release_scope string, artifact string"
)
TIME = dt.datetime(2001, 1, 1)


def row(i, **other):
    base = dict(
        row_id=i, grp=i, score_time=TIME + dt.timedelta(hours=i), outcome="observed_positive" if i % 2 else "observed_negative", split=list(SPLITS)[i % 4], s=0.5, window_complete=True, monitored=True, built=True, linked=True, late_field=False, foreign_field=False,
        horizon="h14", threshold_version="v1", censor_reason=None, system="orders", evidence=None, source_system="ledger", private_data=False, predeclared_at=dt.datetime(1990, 1, 1), release_scope="public", artifact="report",
    )
    return tuple((base | other).values())


def corpus_of(spark, rows):
    return spark.createDataFrame(rows, KIND)


def clean(n=1000, **other):
    return [row(i, **other) for i in range(n)]


REPLAY = {
    "single_system_boundary": [row(1000, system="returns")], "frozen_split_boundaries": None, "cluster_by_change": [row(1001, grp=0)], "release_scope_metadata": [row(1000, release_scope=" ")],
    "threshold_freeze": [row(1000, threshold_version="")], "horizon_freeze": [row(1000, horizon="h7")],
}


@pytest.mark.parametrize("name", [None, *E.CONSTRAINTS])
def test_replay_constraints_fail_one_by_one(spark, name):
    rows = clean() if name != "frozen_split_boundaries" else [row(4 * i) for i in range(9)]
    df = corpus_of(spark, rows + (REPLAY.get(name) or []))
    got = E.replay_constraints(df.withColumn("scope", F.lit("all")), list(SPLITS)).orderBy("position").collect()
    assert [r["name"] for r in got] == E.CONSTRAINTS
    assert [r["name"] for r in got if r["failed"]] == ([name] if name else [])
    assert [r["name"] for r in got if r["first_failure"]] == ([name] if name else [])
    assert name != "frozen_split_boundaries" or got[1]["failed"] == 3


def test_the_first_of_several_constraints_is_named_and_rows_without_a_group_do_not_leak(spark):
    df = corpus_of(spark, clean(8) + [row(8, grp=None), row(9, grp=None), row(10, horizon="h7", release_scope=None)]).withColumn("scope", F.lit("all"))
    got = E.replay_constraints(df, list(SPLITS)).collect()
    assert {r["name"] for r in got if r["failed"]} == {"release_scope_metadata", "horizon_freeze"}
    assert [r["name"] for r in got if r["first_failure"]] == ["release_scope_metadata"]
    assert E.replay_constraints(df.where("false"), list(SPLITS)).count() == 0


REPEATED = [row(i, grp=1, score_time=TIME, outcome="observed_positive") for i in (1001, 1003)]
FEASIBLE = {
    None: ("feasible", clean() + REPEATED), "predeclaration_order": ("blocked", clean() + REPEATED + [row(2000, predeclared_at=dt.datetime(2030, 1, 1))]), "commensurability": ("blocked", clean() + REPEATED + [row(2000, system="returns")]),
    "terminal_coverage": ("blocked", clean() + REPEATED + [row(2000, linked=False)]), "complete_observations": ("inconclusive", clean(400) + REPEATED), "outcome_diversity": ("inconclusive", [row(2 * i + 1) for i in range(600)] + REPEATED),
    "observation_rate": ("inconclusive", clean(510) + [row(2000 + i, outcome="censored") for i in range(600)] + REPEATED), "release_scope": ("blocked", clean() + REPEATED + [row(2000, foreign_field=True)]),
    "repeatability": ("inconclusive", clean() + REPEATED + [row(1005, grp=1, score_time=TIME, outcome="observed_negative")]),
}


@pytest.mark.parametrize("name", FEASIBLE)
def test_feasibility_gates_fail_one_by_one(spark, name):
    overall, rows = FEASIBLE[name]
    got = E.feasibility(corpus_of(spark, rows).withColumn("scope", F.lit("all"))).collect()
    assert len(got) == 8 and {r["overall"] for r in got} == {overall}
    assert [r["gate"] for r in got if r["status"] != "pass"] == ([name] if name else [])


def test_another_horizon_is_bridgeable_and_no_repeats_are_inconclusive(spark):
    got = {r["gate"]: r for r in E.feasibility(corpus_of(spark, clean() + [row(2000, horizon="h7")]).withColumn("scope", F.lit("all"))).collect()}
    assert got["commensurability"]["status"] == "inconclusive" and got["repeatability"]["status"] == "inconclusive" and got["repeatability"]["value"] == 0


def families(spark, family, n, s_of, split, refused=False):
    return corpus_of(spark, [row(i, split=split, s=s_of(i)) for i in range(n)]).withColumn("family", F.lit(family)).withColumn("broken", F.lit(refused)).withColumn("y", (F.col("row_id") % 2).cast("int"))


def sharp(i):
    return 0.98 if i % 2 else 0.02


def test_family_evaluation_verdicts(spark):
    all_splits = lambda f, s_of, **k: families(spark, f, 600, s_of, "calibration_gate", **k).unionAll(families(spark, f, 600, s_of, "test", **k)).unionAll(families(spark, f, 5, s_of, "calibration_fit", **k))
    df = all_splits("good", sharp).unionAll(all_splits("loose", lambda i: 0.9 if i % 2 else 0.4)).unionAll(all_splits("refused", sharp, refused=True)).unionAll(families(spark, "gate only", 600, sharp, "calibration_gate"))
    got = {r["family"]: r for r in E.family_evaluation(df).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"good": "evaluation_evidence", "loose": "inconclusive", "refused": "blocked", "gate only": "inconclusive"}
    assert {k: r["unavailable"] for k, r in got.items()} == {"good": "", "loose": "calibration_conformance", "refused": "admission_report", "gate only": "calibration_fit_rows,test_labeled_outcomes"}
    assert got["good"]["n"] == 600 and got["good"]["rate"] == 0.5 and 0.45 < got["good"]["low"] < 0.5 < got["good"]["high"] < 0.55
    assert got["refused"]["brier"] is None and got["refused"]["n"] == 0 and got["loose"]["gate_reason"] == "calibration error"


def test_corpus_evaluation_verdicts(spark):
    def subset(name, n=1000, more=(), **other):
        rows = [row(i, split="test", s=sharp(i), **other) for i in range(n)]
        return corpus_of(spark, rows + list(more)).withColumn("subset", F.lit(name))

    parts = [
        subset("fine"), subset("few", 700), subset("one class", more=[row(i, split="test", outcome="censored") for i in range(1000, 1010)]).withColumn("outcome", F.lit("observed_positive")), subset("unlinked", more=[row(5000, linked=False)]),
        subset("twice", more=[row(0, split="test")]), subset("mixed", more=[row(5000, horizon="h7")]),
    ]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionAll(p)
    df = df.withColumn("y", F.when(F.col("outcome") == "observed_positive", 1).when(F.col("outcome") == "observed_negative", 0)).withColumn("change", F.col("s")).withColumn("operational", F.lit(0.5))
    got = {(r["subset"], r["score"]): (r["status"], r["reason"]) for r in E.corpus_evaluation(df).collect()}
    assert got["fine", "change"] == ("qualified", "conforms") and got["fine", "operational"] == ("inconclusive", "no discrimination")
    assert got["few", "change"] == ("inconclusive", "too few rows") and got["one class", "change"] == ("inconclusive", "too few of a class")
    assert got["unlinked", "change"] == got["twice", "operational"] == ("blocked", "integrity") and got["mixed", "change"] == ("blocked", "incommensurable definitions")


def test_cross_family_pools_only_equal_definitions(spark):
    rnd = random.Random(3)
    rows = [(f, round(rnd.random(), 2), rnd.randrange(2)) for f in "abcd" for _ in range(60)] + [("e", sharp(i), i % 2) for i in range(600)] + [("f", sharp(i), i % 2) for i in range(600)]
    own = [("a", "x", "7"), ("b", "x", "7"), ("c", "x", "14"), ("d", "y", "7"), ("e", "z", "7"), ("f", "z", "7")]
    got = {(r["first"], r["second"]): r for r in E.cross_family(spark.createDataFrame(rows, "family string, s double, y int"), spark.createDataFrame(own, "family string, event string, window string")).collect()}
    assert len(got) == 15 and {k for k, r in got.items() if r["pooled_ece"] is not None} == {("a", "b"), ("e", "f")}
    assert got["a", "c"]["relation"] == "bridgeable" and got["a", "d"]["relation"] == "irreducible" and got["e", "f"]["class"] == "structural, commensurable" and got["a", "b"]["class"].endswith(", uncalibrated")
    bins = {}
    for f, s, y in rows:
        if f in "ab":
            b = bins.setdefault(min(int(s * 10 + 1e-9), 9), [0, 0])
            b[0] += s - y
            b[1] += 1
    assert got["a", "b"]["pooled_ece"] == pytest.approx(sum(abs(g) for g, _ in bins.values()) / 120)


def test_efficacy_reasons(spark):
    def run(name, n, s_of, b_of, split="test", start=0):
        return [(name, "f", i + start, split, i % 2, s_of(i), b_of(i)) for i in range(n)]

    half, flat = lambda i: 0.6 if i % 4 else 0.5, lambda i: 0.5
    rows = run("good", 900, sharp, half) + run("few", 90, sharp, half) + run("flat", 900, flat, half) + run("worse", 900, half, sharp) + run("loose", 900, lambda i: 0.7 if i % 2 else 0.4, half) + run("one", 900, sharp, half)
    rows = [(*r[:4], 1 if r[0] == "one" else r[4], *r[5:]) for r in rows] + run("good", 50, sharp, half, "train", 5000) + run("leaky", 900, sharp, half) + run("leaky", 1, sharp, half, "calibration")
    got = {r["run"]: r for r in E.efficacy(spark.createDataFrame(rows, "run string, family string, unit long, split string, y int, s double, baseline double")).collect()}
    assert got["good"]["status"] == "passed" and got["good"]["reasons"] == "" and got["good"]["candidate_auc"] == 1.0
    assert got["leaky"]["reasons"] == "split units overlap" and got["leaky"]["candidate_auc"] is None and got["leaky"]["shared"] == 1
    assert got["few"]["reasons"] == "too few rows; too few positives; too few negatives" and got["flat"]["reasons"].startswith("constant score; area below threshold; gain below threshold")
    assert "Brier score worse than the baseline's" in got["worse"]["reasons"] and got["loose"]["reasons"] == "calibration error above threshold"
    assert got["one"]["reasons"].startswith("too few negatives; one outcome class") and all(r["status"] == "not_claimable" for k, r in got.items() if k != "good")


def test_relation_classes_count_all_pairs(spark):
    rnd = random.Random(7)
    rows = [(i, "hot" if i % 3 else f"g{i % 5}", *(f"{f}{rnd.randrange(2)}" for f in FIELDS)) for i in range(80)]
    got = {r["id"]: r for r in D.relation_classes(spark.createDataFrame(rows, f"id long, brand string, {', '.join(f + ' string' for f in FIELDS)}"), "brand").collect()}
    want = {i: dict(direct=0, window_only=0, thresholds_only=0, both=0, irreducible=0) for i, *_ in rows}
    for a, b in itertools.permutations(rows, 2):
        if a[1] == b[1]:
            e, p, w, t = (x != y for x, y in zip(a[2:], b[2:]))
            want[a[0]]["irreducible" if e or p else "both" if w and t else "window_only" if w else "thresholds_only" if t else "direct"] += 1
    assert {i: {k: got[i][k] for k in w} for i, w in want.items()} == want
    assert all(got[i]["may_pool"] == (w["direct"] > 0) for i, w in want.items())
    least = {}
    for i, *key in rows:
        least.setdefault(tuple(key), i)
    assert all(got[i]["direct_class"] == least[tuple(key)] for i, *key in rows)


@pytest.mark.parametrize("report", ["reproduced", "inconclusive", "blocked"])
def test_label_report(spark, report):
    # Two sources with one definition, one with another window, one with another event.
    canon = spark.createDataFrame([(1, "e", "p", "w", "t"), (2, "e", "p", "w", "t"), (3, "e", "p", "w2", "t"), (4, "e2", "p", "w", "t")], "id long, event string, process string, window string, thresholds string")
    licence, current = " " if report == "blocked" else "CC-BY", report == "reproduced"
    sources = [("a", 1, True, "CC-BY", True, True), ("b", 2, True, "CC-BY", True, False), ("c", 3, True, "CC-BY", True, True), ("d", 4, True, licence, current, True)]
    got = {(r["first"], r["second"]): r for r in D.label_comparison(spark.createDataFrame(sources, "source string, id long, available boolean, licence string, current boolean, bridged boolean"), canon).collect()}
    # A comparison that is unavailable blocks the report, whatever made it so.
    assert {r["report"] for r in got.values()} == {"reproduced" if report == "reproduced" else "blocked"} and len(got) == 6
    assert got["a", "b"]["comparison"] == "direct" and got["a", "c"]["reason"] == "window" and got["b", "c"]["reason"] == "bridge evidence is required"
    assert got["a", "d"]["comparison"] == ("irreducible" if report == "reproduced" else "unavailable")
