"""Gates that end in a verdict: replay constraints, feasibility, and evaluations of families apart and side by side.

Each judges several subsets of a corpus at once (`all` rows, only the `admitted` ones), so that verdicts of all kinds
come out of one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import label_of, wilson
from ..operators import metrics as M
from ..operators.gates import worst
from ..registry import query
from .bindings import CORPUS, SCORED, SPLITS, corpus, scored
from .calibration import BASE, BINNED, CURVE, REASON, rounded
from .gates import ROW_RULES_SQL, SYSTEM, blank, many, row_rules, terminal_counts

#: Floors of an evaluation: rows, and rows of each outcome class.
LEAST_ROWS, LEAST_OF_CLASS = 800, 50
LEAST_AUC, LEAST_GAIN, MOST_ERROR = 0.55, 0.01, 0.05


def broken_sql(*without: str) -> str:
    return "(" + " OR ".join(f"coalesce({c}, false)" for n, c in ROW_RULES_SQL.items() if n not in without) + ")"


SCOPED = f"scoped AS (SELECT corpus.*, unnest(CASE WHEN {broken_sql()} THEN ['all'] ELSE ['all', 'admitted'] END) AS scope FROM corpus)"


def broken(*without: str) -> F.Column:
    """Whether a row breaks a row rule of admission, other than those named."""
    return F.exists(F.array(*(F.coalesce(bad, F.lit(True)) for n, bad in row_rules().items() if n not in without)), lambda b: b)


def in_subsets(df: DataFrame, name: str, **subsets: F.Column) -> DataFrame:
    """Each row once for each subset that it belongs to, with the subset's name in the named column."""
    names = F.array(*(F.when(member, F.lit(k.replace("_", " "))) for k, member in subsets.items()))
    return df.withColumn(name, F.explode(F.filter(names, lambda n: n.isNotNull())))


def scoped(df: DataFrame) -> DataFrame:
    return in_subsets(df, "scope", all=F.lit(True), admitted=~broken())


CONSTRAINTS = ["single_system_boundary", "frozen_split_boundaries", "cluster_by_change", "release_scope_metadata", "threshold_freeze", "horizon_freeze"]


def replay_constraints(df: DataFrame, splits: list[str]) -> DataFrame:
    """df: scope and corpus columns -> (scope, position, name, failed, first_failure) for all constraints, in order.

    failed counts rows, missing splits or leaking groups. A row without a group is its own group. A scope without rows
    has no report. Rows are summed by group and then by scope, so no group has to fit in one task."""
    c = F.col
    group = F.coalesce(c("grp").cast("string"), F.concat(F.lit("row "), c("row_id").cast("string")))
    per = df.groupBy("scope", group.alias("_g")).agg(
        many(c("system") != SYSTEM).alias("foreign"), *(F.max((c("split") == s).cast("int")).alias(f"has_{i}") for i, s in enumerate(splits)),
        (F.coalesce(F.min("split"), F.lit("")) != F.coalesce(F.max("split"), F.lit(""))).alias("leaks"), many(blank(c("release_scope"))).alias("unscoped"),
        many(blank(c("threshold_version"))).alias("loose"), many(c("horizon") != "h14").alias("moved"),
    )
    present = [F.coalesce(F.max(f"has_{i}"), F.lit(0)) for i in range(len(splits))]
    t = per.groupBy("scope").agg(F.sum("foreign").alias("f0"), (len(splits) - sum(present[1:], present[0])).cast("long").alias("f1"), many(c("leaks")).alias("f2"), F.sum("unscoped").alias("f3"), F.sum("loose").alias("f4"), F.sum("moved").alias("f5"))
    failed = F.array(*(c(f"f{i}") for i in range(len(CONSTRAINTS))))
    first = F.array_position(F.transform(failed, lambda n: n > 0), F.lit(True))
    names = F.array(*map(F.lit, CONSTRAINTS))
    rows = t.select("scope", first.alias("first"), F.posexplode(F.arrays_zip(names.alias("name"), failed.alias("failed"))).alias("position", "x"))
    return rows.select("scope", (c("position") + 1).alias("position"), "x.name", "x.failed", (c("position") + 1 == c("first")).alias("first_failure"))


@query(f"""WITH {CORPUS}, {SCOPED}, f AS (
 SELECT scope, 1 AS position, 'single_system_boundary' AS name, count(*) FILTER (WHERE system <> 'orders') AS failed FROM scoped GROUP BY scope
 UNION ALL SELECT scope, 2, 'frozen_split_boundaries', 4 - count(DISTINCT split) FROM scoped GROUP BY scope
 UNION ALL SELECT scope, 3, 'cluster_by_change', count(*) FILTER (WHERE n > 1) FROM (SELECT scope, grp, count(DISTINCT split) AS n FROM scoped GROUP BY ALL) GROUP BY scope
 UNION ALL SELECT scope, 4, 'release_scope_metadata', count(*) FILTER (WHERE trim(release_scope) = '') FROM scoped GROUP BY scope
 UNION ALL SELECT scope, 5, 'threshold_freeze', count(*) FILTER (WHERE trim(threshold_version) = '') FROM scoped GROUP BY scope
 UNION ALL SELECT scope, 6, 'horizon_freeze', count(*) FILTER (WHERE horizon <> 'h14') FROM scoped GROUP BY scope)
 SELECT *, failed > 0 AND position = min(position) FILTER (WHERE failed > 0) OVER (PARTITION BY scope) AS first_failure FROM f""")
def g_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay constraints in order, and which of them fails first."""
    return replay_constraints(scoped(corpus(spark, sf_dir)), list(SPLITS))


def feasibility(df: DataFrame) -> DataFrame:
    """df: scope and corpus columns -> (scope, gate, status, value, overall): eight gates and their worst.

    Repeatability: observed rows of one group at one time are repeated executions, which must have one outcome. Rows of
    another system make the lanes irreducible (fail), another horizon or threshold only bridgeable (inconclusive)."""
    c = F.col
    t = terminal_counts(df, ["scope"], late=many(c("predeclared_at") >= c("score_time")), foreign=many(c("system") != SYSTEM), other=many((c("horizon") != "h14") | blank(c("threshold_version"))))
    repeats = df.where("outcome <> 'censored'").groupBy("scope", "grp", "score_time").agg(F.count("*").alias("k"), F.min("outcome").alias("a"), F.max("outcome").alias("b")).where("k > 1")
    repeats = repeats.groupBy("scope").agg(F.count("*").alias("checks"), many(c("a") != c("b")).alias("differing"))
    t = t.join(repeats, "scope", "left").fillna(0, ["checks", "differing"])
    ok = lambda x, other: F.when(x, "pass").otherwise(other)
    gates = {
        "predeclaration_order": (ok(c("late") == 0, "fail"), c("late")),
        "commensurability": (F.when(c("foreign") > 0, "fail").when(c("other") > 0, "inconclusive").otherwise("pass"), c("foreign") + c("other")),
        "terminal_coverage": (ok(c("terminal") == c("selected"), "fail"), c("terminal")),
        "complete_observations": (ok(c("complete") >= 500, "inconclusive"), c("complete")),
        "outcome_diversity": (ok((c("positive") > 0) & (c("negative") > 0), "inconclusive"), c("complete")),
        "observation_rate": (ok(F.try_divide("complete", "selected") >= 0.5, "inconclusive"), c("complete")),
        "release_scope": (ok(c("withheld") == 0, "fail"), c("withheld")),
        "repeatability": (ok((c("checks") > 0) & (c("differing") == 0), "inconclusive"), c("checks")),
    }
    each = F.array(*(F.struct(F.lit(n).alias("gate"), s.alias("status"), v.alias("value")) for n, (s, v) in gates.items()))
    overall = worst([s for s, _ in gates.values()])
    named = F.when(overall == "fail", "blocked").when(overall == "inconclusive", "inconclusive").otherwise("feasible")
    return t.select("scope", F.explode(each).alias("g"), named.alias("overall")).select("scope", "g.*", "overall")


@query(f"""WITH {CORPUS}, {SCOPED}, r AS (SELECT scope, count(*) AS checks, count(*) FILTER (WHERE a <> b) AS differing FROM (SELECT scope, grp, score_time, min(outcome) AS a, max(outcome) AS b FROM scoped WHERE outcome <> 'censored' GROUP BY scope, grp, score_time HAVING count(*) > 1) GROUP BY scope),
 t0 AS (SELECT scope, count(*) AS selected, count(*) FILTER (WHERE linked) AS terminal, count(*) FILTER (WHERE linked AND outcome <> 'censored') AS complete, count(*) FILTER (WHERE linked AND outcome = 'observed_positive') AS positive,
  count(*) FILTER (WHERE linked AND outcome = 'observed_negative') AS negative, count(*) FILTER (WHERE foreign_field) AS withheld, count(*) FILTER (WHERE predeclared_at >= score_time) AS late,
  count(*) FILTER (WHERE system <> 'orders') AS foreign_rows, count(*) FILTER (WHERE horizon <> 'h14' OR trim(threshold_version) = '') AS other FROM scoped GROUP BY scope),
 t AS (SELECT t0.*, coalesce(checks, 0) AS checks, coalesce(differing, 0) AS differing FROM t0 LEFT JOIN r USING (scope)), g AS (
 SELECT scope, 'predeclaration_order' AS gate, CASE WHEN late = 0 THEN 'pass' ELSE 'fail' END AS status, late AS value FROM t
 UNION ALL SELECT scope, 'commensurability', CASE WHEN foreign_rows > 0 THEN 'fail' WHEN other > 0 THEN 'inconclusive' ELSE 'pass' END, foreign_rows + other FROM t
 UNION ALL SELECT scope, 'terminal_coverage', CASE WHEN terminal = selected THEN 'pass' ELSE 'fail' END, terminal FROM t
 UNION ALL SELECT scope, 'complete_observations', CASE WHEN complete >= 500 THEN 'pass' ELSE 'inconclusive' END, complete FROM t
 UNION ALL SELECT scope, 'outcome_diversity', CASE WHEN positive > 0 AND negative > 0 THEN 'pass' ELSE 'inconclusive' END, complete FROM t
 UNION ALL SELECT scope, 'observation_rate', CASE WHEN complete / nullif(selected, 0)::double >= 0.5 THEN 'pass' ELSE 'inconclusive' END, complete FROM t
 UNION ALL SELECT scope, 'release_scope', CASE WHEN withheld = 0 THEN 'pass' ELSE 'fail' END, withheld FROM t
 UNION ALL SELECT scope, 'repeatability', CASE WHEN checks > 0 AND differing = 0 THEN 'pass' ELSE 'inconclusive' END, checks FROM t)
 SELECT *, CASE WHEN bool_or(status = 'fail') OVER (PARTITION BY scope) THEN 'blocked' WHEN bool_or(status <> 'pass') OVER (PARTITION BY scope) THEN 'inconclusive' ELSE 'feasible' END AS overall FROM g""")
def g_feasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight feasibility gates: feasible, inconclusive or blocked."""
    return feasibility(scoped(corpus(spark, sf_dir)))


def with_summary(rows: str, more: str) -> str:
    """SQL of a query over `rows`, which defines measured (family, s, y), with each family's measures in conf."""
    return f"""WITH {rows}, {BINNED.format('measured')}, {CURVE.format('measured')}, {BASE.format('measured')},
 conf AS (SELECT *, {REASON} AS reason FROM (SELECT base.*, ece, auc FROM base JOIN error USING (family) JOIN auc USING (family))) {more}"""


def shown(where: F.Column, count: str) -> F.Column:
    """A count, 0 where there is none to show."""
    return F.coalesce(F.when(where, F.col(count)), F.lit(0))


def family_evaluation(df: DataFrame) -> DataFrame:
    """df: family and corpus columns with s, y and broken -> a row a family, never pooled.

    A family with a row that admission refuses is blocked and gets no figures. Others get their test split's measures
    with a Wilson interval and the conformance of their calibration_gate split; what is unavailable makes them
    inconclusive."""
    c = F.col
    counts = df.groupBy("family").agg(many(c("broken")).alias("refused"), many(c("split") == "calibration_fit").alias("fit_rows"))
    measured = df.where("y IS NOT NULL AND split IN ('calibration_gate', 'test')").select("family", "split", "s", "y")
    s = M.conformance(M.summary(measured, ["family", "split"]))
    gate = s.where("split = 'calibration_gate'").select("family", c("n").alias("gate_n"), c("ece").alias("gate_ece"), c("brier").alias("gate_brier"), c("reason").alias("gate_reason"))
    low, high = wilson(c("positives"), c("n"))
    test = s.where("split = 'test'").select("family", "n", "positives", "brier", "ece", "rate", low.alias("low"), high.alias("high"))
    out = counts.join(gate, "family", "left").join(test, "family", "left")
    lacking = F.concat_ws(
        ",", F.when(c("fit_rows") == 0, "calibration_fit_rows"), F.when(c("gate_n").isNull(), "calibration_diagnostics").when(c("gate_reason") != "conforms", "calibration_conformance"), F.when(c("n").isNull(), "test_labeled_outcomes"),
    )
    blocked = c("refused") > 0
    out = out.withColumn("unavailable", F.when(blocked, "admission_report").otherwise(lacking))
    figures = ["gate_ece", "gate_brier", "gate_reason", "brier", "ece", "rate", "low", "high"]
    out = out.withColumns({f: F.when(~blocked, c(f)) for f in figures} | {k: shown(~blocked, k) for k in ("gate_n", "n", "positives")})
    return out.withColumn("status", F.when(blocked, "blocked").when(c("unavailable") != "", "inconclusive").otherwise("evaluation_evidence"))


FAMILIES = f"rows AS (SELECT *, {broken_sql()} AS broken FROM corpus), members AS (SELECT rows.*, CASE outcome WHEN 'observed_positive' THEN 1 WHEN 'observed_negative' THEN 0 END AS y, unnest(CASE WHEN broken THEN ['unfiltered'] ELSE ['unfiltered', 'admitted ' || (row_id % 2)] END) AS name FROM rows)"


@query(with_summary(f"{CORPUS}, {FAMILIES}, measured AS (SELECT name || '/' || split AS family, s, y FROM members WHERE y IS NOT NULL AND split IN ('calibration_gate', 'test'))", """
 , c AS (SELECT name AS family, count(*) FILTER (WHERE broken) AS refused, count(*) FILTER (WHERE split = 'calibration_fit') AS fit_rows FROM members GROUP BY name),
 e AS (SELECT c.family, refused, fit_rows, coalesce(g.n, 0) AS gate_n, round(g.ece, 6) AS gate_ece, round(g.brier, 6) AS gate_brier, g.reason AS gate_reason, coalesce(t.n, 0) AS n, coalesce(t.positives, 0) AS positives, round(t.brier, 6) AS brier, round(t.ece, 6) AS ece, round(t.rate, 6) AS rate,
  CASE WHEN t.n IS NOT NULL THEN round(greatest(0, (t.rate + 3.8416 / (2 * t.n)) / (1 + 3.8416 / t.n) - 1.96 * sqrt(t.rate * (1 - t.rate) / t.n + 3.8416 / (4.0 * t.n * t.n)) / (1 + 3.8416 / t.n)), 6) END AS low,
  CASE WHEN t.n IS NOT NULL THEN round(least(1, (t.rate + 3.8416 / (2 * t.n)) / (1 + 3.8416 / t.n) + 1.96 * sqrt(t.rate * (1 - t.rate) / t.n + 3.8416 / (4.0 * t.n * t.n)) / (1 + 3.8416 / t.n)), 6) END AS high,
  CASE WHEN refused > 0 THEN 'admission_report' ELSE concat_ws(',', CASE WHEN fit_rows = 0 THEN 'calibration_fit_rows' END, CASE WHEN g.n IS NULL THEN 'calibration_diagnostics' WHEN g.reason <> 'conforms' THEN 'calibration_conformance' END, CASE WHEN t.n IS NULL THEN 'test_labeled_outcomes' END) END AS unavailable
  FROM c LEFT JOIN conf g ON g.family = c.family || '/calibration_gate' AND refused = 0 LEFT JOIN conf t ON t.family = c.family || '/test' AND refused = 0)
 SELECT *, CASE WHEN refused > 0 THEN 'blocked' WHEN unavailable <> '' THEN 'inconclusive' ELSE 'evaluation_evidence' END AS status FROM e"""))
def g_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of admitted rows, and one of all rows, which admission blocks."""
    rows = corpus(spark, sf_dir).withColumn("broken", broken()).withColumn("y", label_of(F.col("outcome")))
    names = F.when(F.col("broken"), F.array(F.lit("unfiltered"))).otherwise(F.array(F.lit("unfiltered"), F.concat(F.lit("admitted "), (F.col("row_id") % 2).cast("string"))))
    return rounded(family_evaluation(rows.withColumn("family", F.explode(names))))


def corpus_evaluation(df: DataFrame) -> DataFrame:
    """df: subset, corpus columns, y and two scores, change and operational -> a row a subset and score.

    A subset is blocked, without figures, if a row is of another system, lacks lineage or is there twice, or if its rows
    were judged by more than one definition. Else each score must conform on the test split with the declared floors of
    rows and of both classes. No figure is pooled over the scores."""
    c = F.col
    one = df.groupBy("subset", "row_id").agg(F.count("*").alias("k"), F.max((~c("linked") | (c("system") != SYSTEM)).cast("int")).alias("bad"), F.min(lane()).alias("a"), F.max(lane()).alias("b"))
    t = one.groupBy("subset").agg(many((c("bad") > 0) | (c("k") > 1)).alias("faults"), (F.min("a") != F.max("b")).alias("mixed"))
    scores = F.explode(F.array(*(F.struct(F.lit(n).alias("score"), c(n).alias("s")) for n in ("change", "operational"))))
    rows = df.where("y IS NOT NULL AND split = 'test'").select("subset", scores.alias("x"), "y").select("subset", "x.score", "x.s", "y")
    s = M.conformance(M.summary(rows, ["subset", "score"]), least=LEAST_ROWS, most_error=MOST_ERROR)
    both = t.withColumn("score", F.explode(F.array(F.lit("change"), F.lit("operational")))).join(s, ["subset", "score"], "left")
    few = c("n").isNull() | (c("positives") < LEAST_OF_CLASS) | (c("n") - c("positives") < LEAST_OF_CLASS)
    reason = F.when(c("faults") > 0, "integrity").when(c("mixed"), "incommensurable definitions").when(few, "too few of a class").otherwise(c("reason"))
    blocked = (c("faults") > 0) | c("mixed")
    figures = {k: shown(~blocked, k) for k in ("n", "positives")} | {f: F.when(~blocked, c(f)) for f in ("ece", "brier", "auc", "score_variance")}
    status = F.when(blocked, "blocked").when(reason == "conforms", "qualified").otherwise("inconclusive")
    return both.select("subset", "score", "faults", "mixed", *(v.alias(k) for k, v in figures.items()), reason.alias("reason"), status.alias("status"))


def lane() -> F.Column:
    """What a row's outcome was judged by."""
    return F.concat_ws(" ", F.coalesce("horizon", F.lit("")), F.coalesce("threshold_version", F.lit("")))


STAGE2 = f"""members AS (SELECT corpus.*, CASE outcome WHEN 'observed_positive' THEN 1 WHEN 'observed_negative' THEN 0 END AS y, round(0.5::double + (row_id % 7 - 3) * 0.001::double, 6) AS operational,
 unnest([x for x in ['all', CASE WHEN NOT {broken_sql('horizon_threshold_freeze')} THEN 'mixed' END, CASE WHEN NOT {broken_sql()} THEN 'admitted' END] if x IS NOT NULL]) AS subset FROM corpus)"""


@query(with_summary(f"{CORPUS}, {STAGE2}, measured AS (SELECT subset || '/change' AS family, s, y FROM members WHERE y IS NOT NULL AND split = 'test' UNION ALL SELECT subset || '/operational', operational, y FROM members WHERE y IS NOT NULL AND split = 'test')", """
 , t AS (SELECT subset, count(*) FILTER (WHERE k > 1 OR bad) AS faults, min(a) <> max(b) AS mixed FROM (SELECT subset, row_id, count(*) AS k, bool_or(NOT linked OR system <> 'orders') AS bad, min(horizon || ' ' || threshold_version) AS a, max(horizon || ' ' || threshold_version) AS b FROM members GROUP BY subset, row_id) GROUP BY subset),
 e AS (SELECT t.*, f.score, c.* EXCLUDE (reason), CASE WHEN faults > 0 THEN 'integrity' WHEN mixed THEN 'incommensurable definitions' WHEN n IS NULL OR positives < 50 OR n - positives < 50 THEN 'too few of a class' WHEN n < 800 THEN 'too few rows' ELSE c.reason END AS reason
  FROM t CROSS JOIN (VALUES ('change'), ('operational')) f(score) LEFT JOIN conf c ON c.family = t.subset || '/' || f.score AND faults = 0 AND NOT mixed)
 SELECT subset, score, faults, mixed, coalesce(n, 0) AS n, coalesce(positives, 0) AS positives, round(ece, 6) AS ece, round(brier, 6) AS brier, round(auc, 6) AS auc, round(score_variance, 9) AS score_variance, reason, CASE WHEN faults > 0 OR mixed THEN 'blocked' WHEN reason = 'conforms' THEN 'qualified' ELSE 'inconclusive' END AS status FROM e"""))
def g_stage2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus evaluation of all rows, of those whose only fault is another horizon or threshold, and of admitted ones."""
    rows = corpus(spark, sf_dir).withColumn("y", label_of(F.col("outcome"))).withColumn("change", F.col("s")).withColumn("operational", F.round(F.lit(0.5) + (F.col("row_id") % 7 - 3) * 0.001, 6))
    rows = in_subsets(rows, "subset", all=F.lit(True), mixed=~broken("horizon_threshold_freeze"), admitted=~broken())
    e = corpus_evaluation(rows)
    return e.withColumns({k: F.round(k, 9 if k == "score_variance" else 6) for k in ("ece", "brier", "auc", "score_variance")})


def cross_family(df: DataFrame, definitions: DataFrame) -> DataFrame:
    """df (family, s, y) and definitions (family, event, window), a row a family -> a row a pair of families.

    Only families of one definition get a pooled calibration error, as a diagnostic, whether they conform or not. It
    comes from the families' bins, so that the rows are not read again for each pair."""
    c = F.col
    s = M.conformance(M.summary(df, ["family"])).select("family", "n", "ece", "conforms").join(definitions, "family")
    a, b = (s.select(*(c(x).alias(f"{p}_{x}") for x in s.columns)) for p in ("a", "b"))
    both = a.join(F.broadcast(b), c("a_family") < c("b_family"))
    differing = F.concat_ws(",", *(F.when(c(f"a_{f}") != c(f"b_{f}"), f) for f in ("event", "window")))
    relation = F.when(c("a_event") != c("b_event"), "irreducible").when(c("a_window") != c("b_window"), "bridgeable").otherwise("direct")
    both = both.withColumn("relation", relation).withColumn("differing", differing)
    bins = M.reliability(df, ["family"]).select("family", "bin", "n", (c("n") * (c("mean_score") - c("frequency"))).alias("gap"))
    pairs = both.where("relation = 'direct'").select(c("a_family"), c("b_family"), F.explode(F.array("a_family", "b_family")).alias("family"))
    pooled = pairs.join(bins, "family").groupBy("a_family", "b_family", "bin").agg(F.sum("gap").alias("gap"), F.sum("n").alias("n"))
    pooled = pooled.groupBy("a_family", "b_family").agg((F.sum(F.abs("gap")) / F.sum("n")).alias("pooled_ece"))
    fine = c("a_conforms") & c("b_conforms")
    kind = F.concat(F.lit("structural"), F.when(c("relation") == "direct", ", commensurable").otherwise(""), F.when(fine, "").otherwise(", uncalibrated"))
    return both.join(pooled, ["a_family", "b_family"], "left").select(
        c("a_family").alias("first"), c("b_family").alias("second"), "relation", "differing", c("a_n").alias("first_n"), c("b_n").alias("second_n"), c("a_ece").alias("first_ece"), c("b_ece").alias("second_ece"), fine.alias("both_conform"), "pooled_ece", kind.alias("class"),
    )


@query(with_summary(f"{SCORED}, measured AS (SELECT family || (unit % 3) AS family, s, y FROM scored)", """
 , d AS (SELECT conf.*, CASE WHEN right(family, 1) = '2' THEN 'late return' ELSE 'return' END AS event, CASE WHEN right(family, 1) = '1' THEN '14 day' ELSE '7 day' END AS win FROM conf),
 p AS (SELECT a.family AS first, b.family AS second, CASE WHEN a.event <> b.event THEN 'irreducible' WHEN a.win <> b.win THEN 'bridgeable' ELSE 'direct' END AS relation, concat_ws(',', CASE WHEN a.event <> b.event THEN 'event' END, CASE WHEN a.win <> b.win THEN 'window' END) AS differing,
  a.n AS first_n, b.n AS second_n, round(a.ece, 6) AS first_ece, round(b.ece, 6) AS second_ece, a.reason = 'conforms' AND b.reason = 'conforms' AS both_conform FROM d a JOIN d b ON a.family < b.family),
 pool AS (SELECT first, second, sum(abs(gap)) / sum(n) AS pooled_ece FROM (SELECT first, second, bin, sum(n * (mean_score - frequency)) AS gap, sum(n) AS n FROM p JOIN binned ON family IN (first, second) WHERE relation = 'direct' GROUP BY first, second, bin) GROUP BY first, second)
 SELECT p.*, round(pooled_ece, 6) AS pooled_ece, 'structural' || CASE WHEN relation = 'direct' THEN ', commensurable' ELSE '' END || CASE WHEN both_conform THEN '' ELSE ', uncalibrated' END AS "class" FROM p LEFT JOIN pool USING (first, second)"""))
def g_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-family report over six lanes, of which some have the same definition."""
    rows = scored(spark, sf_dir).select(F.concat("family", (F.col("unit") % 3).cast("string")).alias("family"), "s", "y")
    k = F.substring("family", -1, 1)
    own = rows.select("family").distinct().select("family", F.when(k == "2", "late return").otherwise("return").alias("event"), F.when(k == "1", "14 day").otherwise("7 day").alias("window"))
    return rounded(cross_family(rows, own))


def efficacy(df: DataFrame) -> DataFrame:
    """df (run, family, unit, split, y, s, baseline) -> a row a run and family of the test split, never pooled.

    A run in which a unit lies in two splits claims nothing and gets no figures. Else all reasons against a family are
    listed, in order: floors, a constant score, one class, area, gain in area, calibration error, Brier score."""
    c = F.col
    units = df.groupBy("run", "unit").agg(F.min("split").alias("a"), F.max("split").alias("b"))
    shared = units.groupBy("run").agg(many(c("a") != c("b")).alias("shared"))
    models = F.explode(F.array(F.struct(F.lit("candidate").alias("model"), c("s").alias("s")), F.struct(F.lit("baseline").alias("model"), c("baseline").alias("s"))))
    rows = df.where("split = 'test'").select("run", "family", models.alias("x"), "y").select("run", "family", "x.model", "x.s", "y")
    m = M.summary(rows, ["run", "family", "model"])
    mine, base = (m.where(c("model") == k) for k in ("candidate", "baseline"))
    mine = mine.select("run", "family", "n", "positives", c("score_variance").alias("v"), *(c(x).alias(f"candidate_{x}") for x in ("auc", "brier", "ece")))
    both = mine.join(base.select("run", "family", *(c(x).alias(f"baseline_{x}") for x in ("auc", "brier", "ece"))), ["run", "family"]).join(shared, "run")
    both = both.withColumn("auc_gain", c("candidate_auc") - c("baseline_auc"))
    against = F.concat_ws(
        "; ", F.when(c("n") < LEAST_ROWS, "too few rows"), F.when(c("positives") < LEAST_OF_CLASS, "too few positives"), F.when(c("n") - c("positives") < LEAST_OF_CLASS, "too few negatives"), F.when(c("v") <= 0, "constant score"), F.when(c("candidate_auc").isNull(), "one outcome class"),
        F.when(c("candidate_auc") < LEAST_AUC, "area below threshold"), F.when(c("auc_gain") < LEAST_GAIN, "gain below threshold"), F.when(c("candidate_ece") > MOST_ERROR, "calibration error above threshold"), F.when(c("candidate_brier") > c("baseline_brier"), "Brier score worse than the baseline's"),
    )
    leaky = c("shared") > 0
    figures = ["candidate_auc", "baseline_auc", "auc_gain", "candidate_brier", "baseline_brier", "candidate_ece", "baseline_ece"]
    out = both.withColumn("reasons", F.when(leaky, "split units overlap").otherwise(against)).withColumn("status", F.when(c("reasons") == "", "passed").otherwise("not_claimable"))
    return out.select("run", "family", "n", "positives", "shared", *(F.when(~leaky, c(f)).alias(f) for f in figures), "reasons", "status")


PLACED = """item AS (SELECT *, CASE WHEN unit % 10 < 6 THEN 'train' WHEN unit % 10 < 8 THEN 'calibration' ELSE 'test' END AS split FROM scored),
 placed AS (SELECT 'disjoint' AS run, * FROM item UNION ALL SELECT 'leaky', * EXCLUDE (split), CASE WHEN family = 'O' AND unit % 50 = 3 AND s > 0.3335 THEN 'test' ELSE split END FROM item)"""


@query(with_summary(f"{SCORED}, {PLACED}, measured AS (SELECT run || '/' || family || '/candidate' AS family, s, y FROM placed WHERE split = 'test' UNION ALL SELECT run || '/' || family || '/baseline', baseline, y FROM placed WHERE split = 'test')", """
 , o AS (SELECT run, count(*) FILTER (WHERE k > 1) AS shared FROM (SELECT run, unit, count(DISTINCT split) AS k FROM placed GROUP BY run, unit) GROUP BY run),
 m AS (SELECT split_part(family, '/', 1) AS run, split_part(family, '/', 2) AS fam, split_part(family, '/', 3) AS model, * EXCLUDE (family) FROM conf),
 e AS (SELECT a.run, a.fam AS family, a.n, a.positives, o.shared, a.auc AS ca, b.auc AS ba, a.auc - b.auc AS gain, a.brier AS cb, b.brier AS bb, a.ece AS ce, b.ece AS be,
  CASE WHEN o.shared > 0 THEN 'split units overlap' ELSE concat_ws('; ', CASE WHEN a.n < 800 THEN 'too few rows' END, CASE WHEN a.positives < 50 THEN 'too few positives' END, CASE WHEN a.n - a.positives < 50 THEN 'too few negatives' END, CASE WHEN a.score_variance <= 0 THEN 'constant score' END,
  CASE WHEN a.auc IS NULL THEN 'one outcome class' END, CASE WHEN a.auc < 0.55 THEN 'area below threshold' END, CASE WHEN a.auc - b.auc < 0.01 THEN 'gain below threshold' END, CASE WHEN a.ece > 0.05 THEN 'calibration error above threshold' END, CASE WHEN a.brier > b.brier THEN 'Brier score worse than the baseline''s' END) END AS reasons
  FROM m a JOIN m b ON a.run = b.run AND a.fam = b.fam AND a.model = 'candidate' AND b.model = 'baseline' JOIN o ON o.run = a.run)
 SELECT run, family, n, positives, shared, """ + ", ".join(f"CASE WHEN shared = 0 THEN round({a}, 6) END AS {b}" for a, b in (("ca", "candidate_auc"), ("ba", "baseline_auc"), ("gain", "auc_gain"), ("cb", "candidate_brier"), ("bb", "baseline_brier"), ("ce", "candidate_ece"), ("be", "baseline_ece"))) + ", reasons, CASE WHEN reasons = '' THEN 'passed' ELSE 'not_claimable' END AS status FROM e"))
def g_efficacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Efficacy per family in two runs: one with disjoint splits, one in which some units reach the test split too."""
    last, leaked = F.col("unit") % 10, (F.col("family") == "O") & (F.col("unit") % 50 == 3) & (F.col("s") > 0.3335)
    split = F.when(last < 6, "train").when(last < 8, "calibration").otherwise("test")
    runs = F.explode(F.array(F.struct(F.lit("disjoint").alias("run"), split.alias("split")), F.struct(F.lit("leaky").alias("run"), F.when(leaked, "test").otherwise(split).alias("split"))))
    return rounded(efficacy(scored(spark, sf_dir).withColumn("x", runs).select("x.run", "x.split", "family", "unit", "y", "s", "baseline")))
