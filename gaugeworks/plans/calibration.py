"""Calibration and discrimination of scored predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import BIN_SQL
from ..operators import metrics as M
from ..registry import query
from .bindings import LABELLED, SCORED, labelled, scored

BINNED = f"""
binned AS (SELECT family, {BIN_SQL} AS bin, count(*) AS n, avg(s) AS mean_score, avg(y::double) AS frequency FROM {{0}} GROUP BY ALL),
error AS (SELECT family, sum(n * abs(mean_score - frequency)) / sum(n) AS ece FROM binned GROUP BY family)"""
CURVE = """
per AS (SELECT family, s, sum(y)::bigint AS pos, sum(1 - y)::bigint AS neg FROM {0} GROUP BY ALL),
curve AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pb, coalesce(sum(neg) OVER w, 0) AS nb FROM per
          WINDOW w AS (PARTITION BY family ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
auc AS (SELECT family, sum(pos * (nb + neg / 2.0))::double / nullif(sum(pos)::double * sum(neg)::double, 0) AS auc FROM curve GROUP BY family)"""
BASE = "base AS (SELECT family, count(*) AS n, sum(y)::bigint AS positives, avg(y::double) AS rate, avg(s) AS mean_score, var_pop(s) AS score_variance, avg(pow(s - y, 2)) AS brier FROM {0} GROUP BY family)"


def summary_sql(rows: str, name: str, more: str) -> str:
    return f"WITH {rows}, {BINNED.format(name)}, {CURVE.format(name)}, {BASE.format(name)}, summary AS (SELECT base.*, ece, auc FROM base JOIN error USING (family) JOIN auc USING (family)) {more}"


REASON = """CASE WHEN n < 500 THEN 'too few rows' WHEN positives = 0 OR positives = n THEN 'one outcome class' WHEN ece > 0.05 THEN 'calibration error'
  WHEN auc IS NULL OR score_variance <= 0 THEN 'no discrimination' ELSE 'conforms' END"""
REPORT = f"SELECT family, n, positives, round(rate, 6) AS rate, round(brier, 6) AS brier, round(ece, 6) AS ece, round(auc, 6) AS auc, {REASON} AS reason FROM summary"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def report(df: DataFrame) -> DataFrame:
    return rounded(M.conformance(M.summary(df, ["family"])).select("family", "n", "positives", "rate", "brier", "ece", "auc", "reason"))


@query(summary_sql(LABELLED, "labelled", REPORT))
def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(labelled(spark, sf_dir))


@query(summary_sql(SCORED, "scored", REPORT))
def m_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scored(spark, sf_dir))


@query(summary_sql(SCORED, "scored", "SELECT family, n, positives, round(rate, 6) AS rate, round(mean_score, 6) AS mean_score, round(score_variance, 9) AS score_variance, round(brier, 6) AS brier, round(ece, 6) AS ece, round(auc, 6) AS auc, CASE WHEN auc IS NULL THEN 'one outcome class' END AS auc_reason FROM summary"))
def m_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.summary(scored(spark, sf_dir), ["family"])
    return rounded(s.withColumn("score_variance", F.round("score_variance", 9)).drop("score_variance")).join(s.select("family", F.round("score_variance", 9).alias("score_variance")), "family")


@query(f"WITH {SCORED} SELECT family, round(avg(pow(s - y, 2)), 6) AS brier FROM scored GROUP BY family")
def a_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("family").agg(F.round(F.avg(F.pow(F.col("s") - F.col("y"), 2)), 6).alias("brier"))


@query(f"WITH {LABELLED}, {BINNED.format('labelled')} SELECT family, bin, n, round(mean_score, 6) AS mean_score, round(frequency, 6) AS frequency FROM binned")
def a_reliab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.reliability(labelled(spark, sf_dir), ["family"]))


EDGES = "edges AS (SELECT l_linestatus AS family, round(l_discount * 10, 1) AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"


@query(f"WITH {EDGES}, {BINNED.format('edges')} SELECT family, bin, n, round(mean_score, 6) AS mean_score, round(frequency, 6) AS frequency FROM binned")
def a_reliab_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that lie on the bins' edges."""
    from ..sources.tables import table

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("family"), F.round(F.col("l_discount") * 10, 1).alias("s"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))
    return rounded(M.reliability(rows, ["family"]))


@query(f"WITH {SCORED}, {BINNED.format('scored')} SELECT family, round(ece, 6) AS ece FROM error")
def a_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.calibration_error(scored(spark, sf_dir), ["family"]))


@query(f"WITH {SCORED}, {CURVE.format('scored')} SELECT family, round(auc, 6) AS auc FROM auc")
def m_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.roc_auc(scored(spark, sf_dir), ["family"]))


@query(f"WITH {LABELLED}, per AS (SELECT family, s, sum(y)::bigint AS pos, sum(1 - y)::bigint AS neg FROM labelled GROUP BY ALL) SELECT family, s, pos, neg, coalesce(sum(pos) OVER w, 0)::bigint AS pos_before, coalesce(sum(neg) OVER w, 0)::bigint AS neg_before FROM per WINDOW w AS (PARTITION BY family ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def w_cum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct score with its positives and negatives and those of all lower scores."""
    return M.cumulative(labelled(spark, sf_dir), ["family"])


@query(f"""WITH {LABELLED}, per AS (SELECT family, s, sum(y)::bigint AS pos, count(*) AS k FROM labelled GROUP BY ALL),
 curve AS (SELECT *, sum(pos) OVER w AS tp, sum(k) OVER w AS n FROM per WINDOW w AS (PARTITION BY family ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
 SELECT family, round(sum(pos * (tp::double / n::double)) / nullif(sum(pos), 0), 6) AS ap FROM curve GROUP BY family""")
def m_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.average_precision(labelled(spark, sf_dir), ["family"]))


@query(f"""WITH {SCORED}, d AS (SELECT round(pow(s - y, 2) - pow(baseline - y, 2), 12) AS d FROM scored), k AS (SELECT d, abs(d) AS m FROM d WHERE d <> 0),
 per AS (SELECT m, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END)::bigint AS up, count(*) AS k FROM k GROUP BY m),
 r AS (SELECT *, coalesce(sum(k) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k + 1) / 2.0 AS rank FROM per),
 t AS (SELECT sum(k)::bigint AS pairs, sum(up * rank)::double AS w_plus, sum((k - up) * rank)::double AS w_minus, sum(k::double * k * k - k) AS ties FROM r)
 SELECT pairs, w_plus, w_minus, least(w_plus, w_minus) AS statistic,
  round((least(w_plus, w_minus) - pairs::double * (pairs + 1) / 4) / sqrt(pairs::double * (pairs + 1) * (2 * pairs + 1) / 24 - ties / 48), 6) AS z FROM t""")
def m_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).selectExpr("s AS a", "baseline AS b", "y")
    return M.squared_error_ranks(rows).withColumn("z", F.round("z", 6))


@query()
def a_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-PAIRED as a whole, with p-value and verdict; m_paired is the part that its SQL repeats."""
    return M.paired_comparison(scored(spark, sf_dir).selectExpr("s AS a", "baseline AS b", "y"))


@query(f"""WITH {LABELLED}, a AS (SELECT family, count(*) AS n, sum(y)::bigint AS positives FROM labelled GROUP BY family), p AS (SELECT *, positives::double / n AS rate FROM a)
 SELECT family, n, positives, round(rate, 6) AS rate,
  round(greatest(0, (rate + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(rate * (1 - rate) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS low,
  round(least(1, (rate + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(rate * (1 - rate) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS high FROM p""")
def m_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.rate_interval(labelled(spark, sf_dir), ["family"]))


@query(f"WITH {LABELLED} SELECT family, sum((s >= 0.5 AND y = 1)::int)::bigint AS tp, sum((s >= 0.5 AND y = 0)::int)::bigint AS fp, sum((s < 0.5 AND y = 1)::int)::bigint AS fn, sum((s < 0.5 AND y = 0)::int)::bigint AS tn, round(avg(y::double), 6) AS prevalence FROM labelled GROUP BY family")
def a_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.confusion(labelled(spark, sf_dir), ["family"], 0.5))


@query(f"WITH {SCORED} SELECT family, count(*) AS n, round(avg(abs(baseline - y)), 6) AS mae, round(sqrt(avg(pow(baseline - y, 2))), 6) AS rmse FROM scored GROUP BY family")
def a_regr(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("baseline") - F.col("y")
    return rounded(scored(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(F.pow(gap, 2))).alias("rmse")))


@query(f"WITH {SCORED} SELECT family, round(sum(s * w) / sum(w), 6) AS predicted, round(sum(y * w)::double / sum(w), 6) AS observed, count(*) AS n FROM (SELECT *, 1 + unit % 3 AS w FROM scored WHERE s >= 0.332 AND s < 0.335) GROUP BY family")
def m_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted predicted and observed rates inside a score band."""
    rows = scored(spark, sf_dir).where((F.col("s") >= 0.332) & (F.col("s") < 0.335)).withColumn("w", 1 + F.col("unit") % 3)
    mean = lambda c: F.sum(F.col(c) * F.col("w")) / F.sum("w")
    return rounded(rows.groupBy("family").agg(mean("s").alias("predicted"), mean("y").alias("observed"), F.count("*").alias("n")))


POOLS = """pools AS (SELECT 'pool ' || unit % 4 AS pool, family AS member, s, y FROM scored),
 declared AS (SELECT DISTINCT pool, member, CASE WHEN pool = 'pool 3' AND member = 'O' THEN NULL WHEN pool = 'pool 2' AND member = 'O' THEN 'return in 14 days' ELSE 'return in 7 days' END AS definition FROM pools)"""


@query(f"""WITH {SCORED}, {POOLS}, pooled AS (SELECT pool AS family, s, y FROM pools), {BINNED.format('pooled')},
 g AS (SELECT pool, count(DISTINCT definition) AS definitions, count(DISTINCT definition) = 1 AND count(definition) = count(*) AS poolable FROM declared GROUP BY pool)
 SELECT pool, (SELECT count(*) FROM pools p WHERE p.pool = g.pool) AS n, definitions, poolable, CASE WHEN poolable THEN round(ece, 6) END AS pooled_ece FROM g JOIN error ON error.family = g.pool""")
def a_poolece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration error of the families' union in four pools. In one pool the definitions differ and in one a family
    has none, so that these two get no figure."""
    rows = scored(spark, sf_dir).select(F.concat(F.lit("pool "), (F.col("unit") % 4).cast("string")).alias("pool"), "family", "s", "y")
    late = F.col("family") == "O"
    definition = F.when(~(late & (F.col("pool") == "pool 3")), F.when(late & (F.col("pool") == "pool 2"), "return in 14 days").otherwise("return in 7 days"))
    return rounded(M.pooled_error(rows, rows.select("pool", "family").distinct().withColumn("definition", definition)))


@query(summary_sql(f"{SCORED}, lanes AS (SELECT (unit % 4)::int AS family, s, y FROM scored)", "lanes", """
 , weighted AS (SELECT *, (family + 1) / 10.0::double AS weight FROM summary)
 SELECT 'lane ' || family::varchar AS lane, n, round(rate, 6) AS rate, round(brier, 6) AS brier FROM weighted
 UNION ALL SELECT 'mixture', sum(n)::bigint, round(sum(weight * rate), 6), round(sum(weight * brier), 6) FROM weighted
 UNION ALL SELECT 'control pool', count(*), round(avg(y), 6), round(avg(pow(s - y, 2)), 6) FROM lanes WHERE family < 2"""))
def m_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture with declared weights beside its lanes, whose targets differ, and a control pool of the two lanes that
    share a target, whose rows may be put together."""
    lanes = M.summary(scored(spark, sf_dir).withColumn("family", F.expr("cast(unit % 4 AS int)")), ["family"]).withColumn("weight", (F.col("family") + 1) / 10.0)
    each = lanes.select(F.concat(F.lit("lane "), F.col("family").cast("string")).alias("lane"), "n", "rate", "brier")
    mixed = lanes.agg(F.lit("mixture").alias("lane"), F.sum("n").alias("n"), F.sum(F.col("weight") * F.col("rate")).alias("rate"), F.sum(F.col("weight") * F.col("brier")).alias("brier"))
    # Lanes 0 and 1 have one target: their sums are those of one sample.
    share = F.col("n") / F.sum("n").over(Window.partitionBy("_pool"))
    pool = lanes.where("family < 2").withColumn("_pool", F.lit(0)).withColumn("_share", share)
    control = pool.agg(F.lit("control pool").alias("lane"), F.sum("n").alias("n"), F.sum(F.col("_share") * F.col("rate")).alias("rate"), F.sum(F.col("_share") * F.col("brier")).alias("brier"))
    return rounded(each.unionByName(mixed).unionByName(control))


@query(f"""WITH {LABELLED}, q AS (SELECT * FROM labelled WHERE family = 'quality'), n AS (SELECT count(*) AS n, greatest(1, ceil(0.2 * count(*)))::bigint AS k, sum(y) AS all_y FROM q),
 top AS (SELECT y FROM (SELECT y, row_number() OVER (ORDER BY s DESC, id) AS rn FROM q), n WHERE rn <= k)
 SELECT n, k AS selected, (SELECT sum(y) FROM top)::double / k AS selected_rate, (SELECT sum(y) FROM top)::double / all_y AS capture_rate FROM n""")
def k_topfrac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.top_fraction(labelled(spark, sf_dir).where("family = 'quality'"))


@query(f"""WITH {SCORED}, b AS (SELECT family, baseline AS s, y FROM scored), {CURVE.format('b').replace('per AS', 'per2 AS').replace('FROM per', 'FROM per2').replace('curve', 'curve2').replace('auc AS (', 'auc_b AS (')},
 {CURVE.format('scored')}
 SELECT x.family, count(*) AS n, round(any_value(auc.auc), 6) AS candidate_auc, round(any_value(auc_b.auc), 6) AS baseline_auc, round(avg(pow(x.s - x.y, 2)), 6) AS candidate_brier,
  round(avg(pow(x.baseline - x.y, 2)), 6) AS baseline_brier, round(avg(pow(x.baseline - x.y, 2)) - avg(pow(x.s - x.y, 2)), 6) AS gain
 FROM scored x JOIN auc USING (family) JOIN auc_b USING (family) GROUP BY x.family""")
def m_efficacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate beside a baseline, per family."""
    rows = scored(spark, sf_dir)
    brier = lambda c: F.avg(F.pow(F.col(c) - F.col("y"), 2))
    both = rows.groupBy("family").agg(F.count("*").alias("n"), brier("s").alias("candidate_brier"), brier("baseline").alias("baseline_brier"))
    auc = M.roc_auc(rows, ["family"]).withColumnRenamed("auc", "candidate_auc")
    base = M.roc_auc(rows.drop("s").withColumnRenamed("baseline", "s"), ["family"]).withColumnRenamed("auc", "baseline_auc")
    return rounded(both.join(auc, "family").join(base, "family").withColumn("gain", F.col("baseline_brier") - F.col("candidate_brier")))
