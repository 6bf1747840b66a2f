"""Measures of scored predictions. Each takes group columns, so one pass serves all families, models or replicates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import bin_of, wilson


def reliability(df: DataFrame, groups: list[str], bins: int = 10) -> DataFrame:
    """(groups, bin, n, mean_score, frequency); empty bins are left out."""
    return df.groupBy(*groups, bin_of(F.col("s"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("s").alias("mean_score"), F.avg(F.col("y").cast("double")).alias("frequency"))


def calibration_error(df: DataFrame, groups: list[str], bins: int = 10) -> DataFrame:
    """Count-weighted mean gap of the reliability bins."""
    gap = F.abs(F.col("mean_score") - F.col("frequency"))
    return reliability(df, groups, bins).groupBy(*groups).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def pooled_error(df: DataFrame, definitions: DataFrame, bins: int = 10) -> DataFrame:
    """df (pool, family, s, y), definitions (pool, family, definition) -> (pool, n, definitions, poolable, pooled_ece).

    Only a pool all of whose families have a definition, and the same one, gets a calibration error of their union."""
    own = df.groupBy("pool", "family").agg(F.count("*").alias("n")).join(definitions, ["pool", "family"], "left")
    agree = (F.count_distinct("definition") == 1) & (F.count("definition") == F.count("*"))
    gate = own.groupBy("pool").agg(F.sum("n").alias("n"), F.count_distinct("definition").alias("definitions"), agree.alias("poolable"))
    return gate.join(calibration_error(df, ["pool"], bins), "pool").select("pool", "n", "definitions", "poolable", F.when(F.col("poolable"), F.col("ece")).alias("pooled_ece"))


def running(per: DataFrame, groups: list[str], key: str, sums: list[str], ascending: bool = True, ranges: int = 1024) -> DataFrame:
    """Adds x_before for each x in sums: its total over the rows of the group that come before in the order of key.

    per has one row a group and key. The sums are two-level, over ranges of the key (which must lie in [0, 1]; what is
    above goes to the last range) and then inside a range, so that a group with many keys is not sorted by one task."""
    per = per.withColumn("_range", F.floor(F.least(F.col(key), F.lit(1.0)) * ranges))
    way = (lambda c: F.col(c)) if ascending else (lambda c: F.col(c).desc())
    before = Window.partitionBy(*groups).orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)
    total = per.groupBy(*groups, "_range").agg(*(F.sum(x).alias(f"_{x}") for x in sums))
    total = total.select(*groups, "_range", *(F.coalesce(F.sum(f"_{x}").over(before), F.lit(0)).alias(f"_{x}") for x in sums))
    within = Window.partitionBy(*groups, "_range").orderBy(way(key)).rowsBetween(Window.unboundedPreceding, -1)
    out = per.join(total, [*groups, "_range"])
    return out.select(*per.columns, *((F.col(f"_{x}") + F.coalesce(F.sum(x).over(within), F.lit(0))).alias(f"{x}_before") for x in sums)).drop("_range")


def cumulative(df: DataFrame, groups: list[str], ascending: bool = True) -> DataFrame:
    """One row a distinct score with its positives, negatives, and those of all scores before it."""
    per = df.groupBy(*groups, "s").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum((1 - F.col("y")).cast("long")).alias("neg"))
    return running(per, groups, "s", ["pos", "neg"], ascending)


def roc_auc(df: DataFrame, groups: list[str]) -> DataFrame:
    """Area under the ROC curve with half credit for ties; null when one class is missing."""
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return cumulative(df, groups).groupBy(*groups).agg(F.try_divide(wins, F.sum("pos") * F.sum("neg").cast("double")).alias("auc"))


def average_precision(df: DataFrame, groups: list[str]) -> DataFrame:
    """Sum over distinct scores, the highest first, of the step in recall times the precision; null without positives."""
    tp = F.col("pos_before") + F.col("pos")
    precision = tp / (tp + F.col("neg_before") + F.col("neg"))
    return cumulative(df, groups, ascending=False).groupBy(*groups).agg(F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos").cast("double")).alias("ap"))


def summary(df: DataFrame, groups: list[str], bins: int = 10) -> DataFrame:
    """n, positives, rate, mean score and variance, Brier score, calibration error, AUC, and why there is none.

    All of them come from counts of both outcomes by distinct score: the counts give the sums of each bin, and the bins
    those of the group. The rows are read for the counts and for the counts' running sums, not for each measure."""
    s, pos, neg = F.col("s"), F.col("pos"), F.col("neg")
    w = pos + neg
    per_bin = cumulative(df, groups).groupBy(*groups, bin_of(s, bins).alias("_bin")).agg(
        F.sum(w).alias("w"), F.sum("pos").alias("p"), F.sum(s * w).alias("sw"), F.sum(F.pow(s - 0.5, 2) * w).alias("sq"), F.sum(pos * F.pow(1 - s, 2) + neg * F.pow(s, 2)).alias("loss"),
        F.sum(pos * (F.col("neg_before") + neg / 2.0)).alias("wins"), F.count("*").alias("scores"),
    )
    n, p, mean = F.sum("w"), F.sum("p"), F.sum("sw") / F.sum("w")
    variance = F.when(F.sum("scores") == 1, 0.0).otherwise(F.greatest(F.sum("sq") / n - F.pow(mean - 0.5, 2), F.lit(0.0)))
    out = per_bin.groupBy(*groups).agg(
        n.alias("n"), p.alias("positives"), F.try_divide(p, n).alias("rate"), mean.alias("mean_score"), variance.alias("score_variance"), (F.sum("loss") / n).alias("brier"),
        (F.sum(F.abs(F.col("sw") - F.col("p"))) / n).alias("ece"), F.try_divide(F.sum("wins"), p * (n - p).cast("double")).alias("auc"),
    )
    return out.withColumn("auc_reason", F.when(F.col("auc").isNull(), "one outcome class"))


def conformance(summaries: DataFrame, least: int = 500, most_error: float = 0.05) -> DataFrame:
    """The first rule that a group breaks, in order: rows, classes, calibration error, discrimination."""
    one_class = (F.col("positives") == 0) | (F.col("positives") == F.col("n"))
    reason = (
        F.when(F.col("n") < least, "too few rows").when(one_class, "one outcome class").when(F.col("ece") > most_error, "calibration error")
        .when(F.col("auc").isNull() | (F.col("score_variance") <= 0), "no discrimination").otherwise("conforms")
    )
    return summaries.withColumn("reason", reason).withColumn("conforms", F.col("reason") == "conforms")


def confusion(df: DataFrame, groups: list[str], threshold: float) -> DataFrame:
    hit, y = F.col("s") >= threshold, F.col("y") == 1
    total = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return df.groupBy(*groups).agg(total(hit & y).alias("tp"), total(hit & ~y).alias("fp"), total(~hit & y).alias("fn"), total(~hit & ~y).alias("tn"), F.avg(F.col("y").cast("double")).alias("prevalence"))


def rate_interval(df: DataFrame, groups: list[str]) -> DataFrame:
    agg = df.groupBy(*groups).agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("positives"))
    low, high = wilson(F.col("positives"), F.col("n"))
    return agg.select(*groups, "n", "positives", F.try_divide(F.col("positives"), F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def signed_ranks(df: DataFrame) -> DataFrame:
    """Wilcoxon's signed ranks of paired squared errors. df: a, b (two models' scores), y.

    Pairs without a difference are dropped and ties share the mean rank; z is corrected for ties. Differences are
    grouped before they are ranked, and ranked by running sums. Also the ties' sum and the largest difference."""
    d = F.round(F.pow(F.col("a") - F.col("y"), 2) - F.pow(F.col("b") - F.col("y"), 2), 12)
    per = df.select(d.alias("d")).where("d <> 0").groupBy(F.abs("d").alias("m")).agg(F.sum((F.col("d") > 0).cast("long")).alias("up"), F.count("*").alias("k"))
    ranked = running(per, [], "m", ["k"]).withColumn("rank", F.col("k_before") + (F.col("k") + 1) / 2.0)
    k = F.col("k").cast("double")
    s = ranked.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("pairs"), F.coalesce(F.sum(F.col("up") * F.col("rank")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum((F.col("k") - F.col("up")) * F.col("rank")), F.lit(0.0)).alias("w_minus"), F.coalesce(F.sum(k * k * k - k), F.lit(0.0)).alias("ties"), F.coalesce(F.max("m"), F.lit(0.0)).alias("largest"))
    n = F.col("pairs").cast("double")
    s = s.withColumn("statistic", F.least("w_plus", "w_minus")).withColumn("variance", n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = F.try_divide(F.col("statistic") - n * (n + 1) / 4, F.sqrt("variance"))
    return s.select("pairs", "w_plus", "w_minus", "statistic", z.alias("z"), "ties", "largest")


def squared_error_ranks(df: DataFrame) -> DataFrame:
    """The pairs, rank sums, statistic and z of signed_ranks(); paired_comparison() has the p-value and the verdict."""
    return signed_ranks(df).select("pairs", "w_plus", "w_minus", "statistic", "z")


def wilcoxon_p(pairs: int, statistic: float, z: float | None, ties: float, zeros: int) -> float:
    """Two-sided p-value: exact for up to 50 pairs without ties and zeros, else from z."""
    if pairs == 0 or z is None:
        return 1.0
    if pairs <= 50 and not ties and not zeros:
        ways = [1] + [0] * (pairs * (pairs + 1) // 2)
        for r in range(1, pairs + 1):
            for t in range(len(ways) - 1, r - 1, -1):
                ways[t] += ways[t - r]
        return min(1.0, 2 * sum(ways[: int(statistic) + 1]) / 2**pairs)
    return math.erfc(abs(z) / math.sqrt(2))


def paired_comparison(df: DataFrame) -> DataFrame:
    """Candidate a against baseline b on y: both Brier scores, statistic, p-value, and the verdict at p < .05. Without a
    difference above 1e-8 the statistic is 0 and p is 1."""
    y = F.col("y").cast("double")
    scores = df.agg(F.count("*").alias("n"), F.avg(F.pow(F.col("b") - y, 2)).alias("baseline_brier"), F.avg(F.pow(F.col("a") - y, 2)).alias("candidate_brier"))
    r = signed_ranks(df).crossJoin(F.broadcast(scores))
    same, p = F.col("largest") <= 1e-8, F.udf(wilcoxon_p, "double")("pairs", "statistic", "z", "ties", F.col("n") - F.col("pairs"))
    r = r.withColumn("p_value", F.when(same, 1.0).otherwise(p)).withColumn("statistic", F.when(same, 0.0).otherwise(F.col("statistic")))
    better, worse = F.col("candidate_brier") < F.col("baseline_brier"), F.col("candidate_brier") > F.col("baseline_brier")
    verdict = F.when((F.col("p_value") < 0.05) & better, "candidate significantly better (lower Brier)").when((F.col("p_value") < 0.05) & worse, "candidate significantly worse").otherwise("no significant difference")
    return r.select("n", "pairs", "baseline_brier", "candidate_brier", "statistic", "z", "p_value", verdict.alias("verdict"))


def top_fraction(df: DataFrame, fraction: float = 0.2) -> DataFrame:
    """n, selected, selected rate and share of all positives in the top max(1, ceil(fraction n)) by (-s, id)."""
    from .order import first_by_score

    top = first_by_score(df, fraction, ["id"], {"hits": F.col("y")})
    every = df.agg(F.sum("y").alias("y0"))
    hits = F.col("hits")
    return top.crossJoin(F.broadcast(every)).select(F.col("n").cast("long").alias("n"), F.col("selected").cast("long").alias("selected"), (hits / F.col("selected")).alias("selected_rate"), F.try_divide(hits, F.col("y0")).alias("capture_rate"))
