"""Fitted models over the tables. Solvers differ from other libraries' in the last digits, so these have no SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import BIN_SQL, label_of
from ..operators import metrics as M
from ..operators import models as ML
from ..registry import query
from ..sources.tables import table
from .bindings import CORPUS, corpus, scored
from .gates import admission_failures


#: The fit by its definition: at each score, the largest over starts before it of the least mean from there to an end behind it.
FITTED = """
 per AS (SELECT s, count(*) AS k, sum(y) AS p FROM fit GROUP BY s), sums AS (SELECT s, row_number() OVER w AS i, sum(k) OVER w AS n, sum(p) OVER w AS t, sum(k) OVER w - k AS n0, sum(p) OVER w - p AS t0 FROM per WINDOW w AS (ORDER BY s)),
 spans AS (SELECT a.i AS j, b.i AS i, min((b.t - a.t0)::double / (b.n - a.n0)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS low FROM sums a JOIN sums b ON b.i >= a.i),
 fitted AS (SELECT s AS x, g FROM (SELECT i, max(low) AS g FROM spans GROUP BY i) JOIN sums USING (i)),
 raised AS (SELECT test.* EXCLUDE (s), CASE WHEN lo.x IS NULL THEN hi.g WHEN hi.x IS NULL OR hi.x = lo.x THEN lo.g ELSE lo.g + (hi.g - lo.g) * (test.s - lo.x) / (hi.x - lo.x) END AS s
  FROM test ASOF LEFT JOIN fitted lo ON test.s >= lo.x ASOF LEFT JOIN fitted hi ON test.s <= hi.x)"""

ROWS = "r AS (SELECT row_id, split, s, (outcome = 'observed_positive')::int AS y FROM corpus WHERE outcome <> 'censored')"


@query(f"""WITH {CORPUS}, {ROWS}, fit AS (SELECT * FROM r WHERE split = 'calibration_fit'), test AS (SELECT * FROM r WHERE split = 'test'), {FITTED},
 both_ AS (SELECT 'raw' AS family, s, y FROM test UNION ALL SELECT 'calibrated', s, y FROM raised), b AS (SELECT family, {BIN_SQL} AS bin, count(*) AS n, abs(sum(s) - sum(y)) AS gap FROM both_ GROUP BY ALL)
 SELECT family, count(*) AS n, round(avg(pow(s - y, 2)), 6) AS brier, round((SELECT sum(gap) / sum(n) FROM b WHERE b.family = both_.family), 6) AS ece FROM both_ GROUP BY family""")
def ml_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotonic calibration fitted on one split and measured on another."""
    rows = corpus(spark, sf_dir).where("outcome <> 'censored'").select("split", "s", label_of(F.col("outcome")).alias("y"))
    blocks = ML.isotonic_blocks(rows.where("split = 'calibration_fit'"))
    test = rows.where("split = 'test'").withColumn("family", F.lit("raw"))
    raised = ML.apply_isotonic(test, blocks).select("split", F.col("calibrated").alias("s"), "y", F.lit("calibrated").alias("family"))
    return M.summary(test.unionByName(raised), ["family"]).select("family", "n", F.round("brier", 6).alias("brier"), F.round("ece", 6).alias("ece"))


@query()
def ml_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic baseline beside the prior."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").cast("double").alias("y"), F.when(F.col("o_orderkey") % 41 != 0, F.col("o_totalprice")).alias("price"), F.col("o_custkey").cast("double").alias("customer"), F.col("o_orderpriority").alias("priority"), (F.col("o_orderkey") % 4 == 0).alias("test"))
    model = ML.logistic_baseline(o.where("NOT test"), ["price", "customer"], ["priority"])
    scored_rows = ML.probability(model, o.where("test")).select(F.col("y").cast("int").alias("y"), "s", F.lit("logistic").alias("family"))
    prior = o.where("NOT test").agg(F.avg("y").alias("s"))
    base = o.where("test").select(F.col("y").cast("int").alias("y")).crossJoin(F.broadcast(prior)).withColumn("family", F.lit("prior")).select("y", "s", "family")
    return M.summary(scored_rows.unionByName(base), ["family"]).select("family", "n", F.round("brier", 4).alias("brier"), F.round("auc", 4).alias("auc"))


#: Rows in a partition of a fit of trees.
TREE_ROWS = 250_000


@query()
def ml_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees for remaining life beside the training median."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    dealt = lines.repartition(max(8, -(-lines.count() // TREE_ROWS)), "l_orderkey")  # a fit keeps a partition's rows as objects
    life = F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    rows = dealt.select((life - F.col("l_linenumber")).cast("double").alias("y"), F.col("l_linenumber").cast("double").alias("cycle"), "l_quantity", "l_discount", (F.col("l_orderkey") % 5 == 0).alias("test"))
    model = ML.boosted_regressor(rows.where("NOT test"), ["cycle", "l_quantity", "l_discount"])
    median = rows.where("NOT test").agg(F.percentile("y", F.lit(0.5)).alias("median"))
    test = model.transform(rows.where("test")).crossJoin(F.broadcast(median))
    gap = lambda c: F.round(F.avg(F.abs(F.col(c) - F.col("y"))), 4)
    return test.agg(F.count("*").alias("n"), gap("prediction").alias("model_mae"), gap("median").alias("median_mae"))


@query()
def ml_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ridge predictor from the first to the second half of state vectors, one for each width, and each row's latent
    error e / (e + the width's mean error). Vectors of fewer than two components, or with null or non-finite ones, have
    no anomaly."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("width"))
    fine = (F.col("width") > 1) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    parts = [e.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(None).cast("double").alias("anomaly"))]
    for r in e.where(fine).select("width").distinct().orderBy("width").collect():
        half = r["width"] // 2
        rows = e.where(fine & (F.col("width") == r["width"])).select("vec_id", F.slice("v", 1, half).alias("pre"), F.slice("v", half + 1, r["width"] - half).alias("post"))
        weights = ML.ridge(rows, "pre", "post")
        error = F.aggregate(F.zip_with(ML.predicted(F.col("pre"), weights), F.col("post"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)
        missed = rows.select("vec_id", error.alias("error"))
        scale = missed.agg(F.greatest(F.avg("error"), F.lit(1e-12)).alias("scale"))
        parts.append(missed.crossJoin(F.broadcast(scale)).select("vec_id", F.round(F.col("error") / (F.col("error") + F.col("scale")), 6).alias("anomaly")))
    return reduce(DataFrame.unionAll, parts)


@query("SELECT doc_id, round(1 - exp(-0.002 * (n_chars / 100.0)), 6) AS score, 0 AS violations FROM documents")
def u_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's scorer is a function of DataFrames that adds score and explanation; its output is validated."""
    from ..functions.scores import churn_risk, violations

    def scorer(df: DataFrame) -> DataFrame:
        return df.withColumn("score", churn_risk(F.col("n_chars") / 100)).withColumn("explanation", F.lit("length of the text"))

    signals = table(spark, sf_dir, "documents").select("doc_id", "n_chars").transform(scorer)
    checks = violations((F.col("score").isNull() | ~F.col("score").between(0, 1), "score outside [0, 1]"), (F.trim("explanation") == "", "explanation is blank"))
    return signals.select("doc_id", F.round("score", 6).alias("score"), F.size(checks).alias("violations"))


@query("""WITH r AS (SELECT user_id, ts::date AS day, value, row_number() OVER (PARTITION BY user_id, ts::date ORDER BY ts DESC, event_id DESC) - 1 AS age FROM events WHERE value IS NOT NULL)
 SELECT user_id, day::varchar AS day, round(sum(value * pow(0.7, age)) / sum(pow(0.7, age)), 6) AS forecast FROM r GROUP BY user_id, day""")
def u_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's forecaster is a function of DataFrames too; this one returns each resource's and day's exponential mean."""

    def forecaster(df: DataFrame, alpha: float = 0.3) -> DataFrame:
        # Rows are aged inside an hour, and the hours by the rows behind them, so a busy day is not sorted by one task.
        keep = 1 - alpha
        hour = Window.partitionBy("user_id", "day", "hour").orderBy(F.desc("ts"), F.desc("event_id"))
        weight = F.pow(F.lit(keep), F.row_number().over(hour) - 1)
        per = df.withColumn("w", weight).groupBy("user_id", "day", "hour").agg(F.sum(F.col("w") * F.col("value")).alias("x"), F.sum("w").alias("w"), F.count("*").alias("n"))
        behind = F.coalesce(F.sum("n").over(Window.partitionBy("user_id", "day").orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        per = per.withColumn("fade", F.pow(F.lit(keep), behind))
        return per.groupBy("user_id", "day").agg(F.round(F.sum(F.col("x") * F.col("fade")) / F.sum(F.col("w") * F.col("fade")), 6).alias("forecast"))

    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    return forecaster(e.select("user_id", F.to_date("ts").cast("string").alias("day"), F.hour("ts").alias("hour"), "ts", "event_id", "value"))


@query()
def g_stage1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From rows to a family report: calibrate on one split, admit, evaluate on the test split, never pooled."""
    c = corpus(spark, sf_dir)
    bad = admission_failures(c).where("gate IN ('lineage_linkage', 'outcome_censoring', 'prediction_time_fields')").select("row_id").distinct()
    rows = c.join(bad, "row_id", "left_anti").where("outcome <> 'censored'").select("split", "s", label_of(F.col("outcome")).alias("y"), F.concat(F.lit("orders "), (F.col("row_id") % 2).cast("string")).alias("family"))
    blocks = ML.isotonic_blocks(rows.where("split = 'calibration_fit'"))
    test = ML.apply_isotonic(rows.where("split = 'test'"), blocks).drop("s").withColumnRenamed("calibrated", "s")
    report = M.conformance(M.summary(test, ["family"]))
    return report.select("family", "n", "positives", F.round("brier", 6).alias("brier"), F.round("ece", 6).alias("ece"), F.round("auc", 6).alias("auc"), "reason")
