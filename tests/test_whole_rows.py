"""Fixed answers of the operators that gate, compare and re-check."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import metrics as M
from gaugeworks.plans import files, gates, scoring


def test_a_pool_needs_one_definition_of_all_families(spark):
    rows = [(p, f, s, y) for p in "abc" for f, s, y in (("x", 0.25, 0), ("y", 0.75, 1))]
    df = spark.createDataFrame(rows, "pool string, family string, s double, y int")
    own = spark.createDataFrame([("a", "x", "d"), ("a", "y", "d"), ("b", "x", "d"), ("b", "y", "e"), ("c", "x", "d")], "pool string, family string, definition string")
    got = {r["pool"]: (r["n"], r["definitions"], r["poolable"], r["pooled_ece"]) for r in M.pooled_error(df, own).collect()}
    assert got == {"a": (2, 1, True, 0.25), "b": (2, 2, False, None), "c": (2, 1, False, None)}
    assert M.pooled_error(df.where("false"), own).count() == 0


def sample(spark, rows):
    return spark.createDataFrame(rows, "family string, unit long, s double, y int")


def test_sample_digests_count_repeated_rows_and_ignore_order(spark):
    rows = [("x", 1, 0.5, 1), ("x", 1, 0.5, 1), ("x", 2, 0.25, 0)]
    digest = lambda r: gates.sample_evidence(sample(spark, r).repartition(3)).collect()[0]["sample"]
    assert digest(rows) == digest(rows[::-1])
    assert len({digest(rows), digest(rows[1:]), digest(rows + rows[:1]), digest([("x", 1, 0.5, 0), *rows[1:]]), digest([("x", 1, 0.4, 1), *rows[1:]])}) == 5


@pytest.mark.parametrize(
    "change, reason",
    [({}, ""), ({"definition": "other"}, "second evidence is of another definition"), ({"policy": "other"}, "policies differ"), ({"sample": "0-0"}, "second sample does not match"), ({"n": 3}, "second sample does not match"), (None, "second evidence is of another definition")],
)
def test_each_fault_withholds_the_pooled_error(spark, change, reason):
    df = sample(spark, [("x", 1, 0.25, 0), ("y", 2, 0.75, 1)])
    now = spark.createDataFrame([("x", "d"), ("y", "d")], "family string, definition string")
    stored = gates.sample_evidence(df).withColumn("definition", F.lit("d")).withColumn("policy", F.lit("p"))
    for column, value in (change or {}).items():
        stored = stored.withColumn(column, F.when(F.col("family") == "y", value).otherwise(F.col(column)))
    got = gates.pool_authorization(df, now, stored if change is not None else stored.where("family = 'x'")).collect()
    assert [(r["first"], r["second"], r["authorized"], r["reason"], r["pooled_ece"]) for r in got] == [("x", "y", not reason, reason, None if reason else 0.25)]


def test_other_definitions_are_named_first(spark):
    df = sample(spark, [("x", 1, 0.25, 0), ("y", 2, 0.75, 1)])
    now = spark.createDataFrame([("x", "d"), ("y", "e")], "family string, definition string")
    stored = gates.sample_evidence(df).withColumn("definition", F.lit("d")).withColumn("policy", F.lit("p"))
    assert gates.pool_authorization(df, now, stored).collect()[0]["reason"] == "definitions differ"


def test_selection_changes_by_brute_force(spark):
    rows = [(f, (i * 7 + f) % 2, ((i * 37 + f) % 19) / 19) for f in range(4) for i in range(30 + f)] + [(9, 0, 0.5)]
    got = {r["fixture"]: r["changed"] for r in gates.selection_changes(spark.createDataFrame(rows, "fixture long, target long, s double")).collect()}

    def top(some):
        want = max(1, -(-len(some) // 5))
        return {i for i, s in some if sum(t > s for _, t in some) < want}

    for f in {r[0] for r in rows}:
        mine = [(i, t, s) for i, (g, t, s) in enumerate(rows) if g == f]
        local = set().union(*(top([(i, s) for i, t, s in mine if t == k]) for k in {t for _, t, _ in mine}))
        assert got[f] == len(top([(i, s) for i, _, s in mine]) ^ local)
    assert got[9] == 0 and any(got.values())


def test_rules_err_where_the_declaration_does(spark):
    flags = {f: True for f in gates.FLAGS} | {"mapping_declared": False, "mixture_declared": False, "transport_validated": False}
    case = lambda op, valid, expected, fixture=None, **other: (op, valid, expected, fixture, *(flags | other).values())
    kind = "op string, valid boolean, expected string, fixture long, " + ", ".join(f"{f} boolean" for f in gates.FLAGS)
    rows = [
        case("rank", True, "same target", 1), case("rank", False, "different targets", 1, same_target=False), case("rank", False, "different targets", 1), case("pool", True, "declared mixture", same_target=False, mixture_declared=True),
        case("compare", False, "same target", samples_aligned=False),
    ]
    changes = spark.createDataFrame([(1, 4)], "fixture long, changed long")
    got = {r["rule"]: r for r in gates.rule_comparison(spark.createDataFrame(rows, kind), changes).collect()}
    seen = lambda rule: tuple(got[rule][k] for k in ("false_permissions", "false_refusals", "interpretation_errors", "rankings", "rankings_changed", "selections_changed"))
    assert seen("naive") == (3, 0, 3, 3, 2, 8)
    assert seen("label") == (2, 1, 2, 3, 1, 4)
    assert seen("metadata") == (2, 0, 1, 3, 1, 4)
    assert seen("exact") == (1, 0, 1, 3, 1, 4)
    assert got["naive"]["false_permission_rate"] == 1.0 and got["label"]["false_refusal_rate"] == 0.5


def test_each_violation_of_a_stored_report(spark):
    base = {"n": 4, "p": 2, "q": 2, "z": 0, "selected": 5, "metric": 0.5, "fields": "counts"}
    faults = [
        ({}, None, set()), ({}, {"p": 1, "q": 3}, {"identity does not match"}), ({"metric": 2.0}, None, {"metric out of domain"}), ({"fields": "operational_score"}, None, {"raw scores published"}), ({"n": 2, "p": 1, "q": 1}, None, {"below floor"}),
        ({"selected": 3}, None, {"terminal count exceeds selected"}), ({"q": 1, "z": 1}, None, {"counts do not add up"}), ({"z": 1}, None, {"classes do not add up"}), ({"metric": None}, None, {"metric out of domain"}),
    ]
    kind = "k int, n long, p long, q long, z long, selected long, metric double, fields string"
    stored = spark.createDataFrame([(k, *(base | f).values()) for k, (f, _, _) in enumerate(faults)], kind).withColumn("identity", gates.report_identity())
    for k, (_, later, _) in enumerate(faults):
        for column, value in (later or {}).items():
            stored = stored.withColumn(column, F.when(F.col("k") == k, value).otherwise(F.col(column)))
    got = [(r["k"], r["violation"]) for r in gates.recheck_reports(stored, "k").collect()]
    assert sorted(got) == sorted((k, v) for k, (_, _, want) in enumerate(faults) for v in want)


def test_manifests_and_their_decisions(spark):
    kind = "name string, dataset_id string, claim_boundary string, source struct<retrieval_reference:string>, canonical_source string, digest string"
    rows = [
        ("a", "a", "x", None, "https://a", "1"), ("b", "b", "x", ("https://b",), None, "2"), ("c", "d", "x", None, "https://c", "3"), ("e", "e", " ", None, "https://e", "4"), ("f", "f", "x", None, "http://f", "5"), ("g", "g", "x", None, None, "6"),
        ("h", None, None, None, None, None), ("i", "i", "x", None, "https://i", "7"), ("j", "j", "x", None, "https://j", "8"), ("k", "k", "x", None, "https://k", "9"),
    ]
    ledger = spark.createDataFrame([("a", "accepted", "1"), ("b", "accepted", "0"), ("i", "deferred", None), ("j", "accepted", None)], "dataset_id string, status string, sha256 string")
    got = {r["name"]: (r["error"], r["verdict"]) for r in files.catalog_verdicts(spark.createDataFrame(rows, kind), ledger).collect()}
    bad = "invalid manifest"
    assert got == {
        "a": (None, "admitted"), "b": (None, "artifact differs"), "c": ("invalid dataset identity", bad), "e": ("no claim boundary", bad), "f": ("no canonical HTTPS source", bad), "g": ("no canonical HTTPS source", bad),
        "h": ("invalid dataset identity", bad), "i": (None, "deferred"), "j": (None, "artifact not pinned"), "k": (None, "no decision"),
    }


def test_latent_scores_of_odd_vectors(spark):
    rows = [(1, [2.0, 1.0]), (2, [2.0, 3.0]), (3, None), (4, []), (5, [1.0]), (6, [1.0, float("nan")]), (7, [1.0, None])]
    got = {r["k"]: r for r in scoring.latent_scores(spark.createDataFrame(rows, "k int, v array<double>"), "k").collect()}
    assert [k for k, r in got.items() if r["ok"]] == [1, 2]
    assert got[1]["anomaly"] == 0.0 and got[2]["anomaly"] == pytest.approx(4 / (4 + 2))
    assert got[1]["risk"] == pytest.approx(1 / (1 + 2.718281828459045 ** -0.4))
    assert all(got[k]["anomaly"] is None and got[k]["risk"] is None for k in range(3, 8))
