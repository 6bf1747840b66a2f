"""Bootstrap intervals with draws that any engine can repeat: a draw's row is a hash of (seed, replicate, draw)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import BIN_SQL
from ..operators import metrics as M
from ..registry import query
from ..sources.store import scratch
from ..sources.tables import table
from .bindings import LABELLED, labelled


def draws(spark: SparkSession, replicates: int, size: int, seed: int = 0) -> DataFrame:
    """(replicate, draw, h): h is a 32-bit hash; modulo n it is a position drawn from n with replacement."""
    rows = spark.range(replicates * size).select(F.floor(F.col("id") / size).alias("replicate"), (F.col("id") % size).alias("draw"))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("draw").cast("string"))
    return rows.withColumn("h", F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"))


def drawn(picks: DataFrame, classes: DataFrame) -> DataFrame:
    at = F.col("h") % F.col("n")
    return picks.join(classes, (at >= F.col("lo")) & (at < F.col("hi")))


def classes_of(df: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    """Rows with equal values as one class with the half-open range [lo, hi) of positions it takes in its group, and n.

    Drawing a row is drawing a position, so a bootstrap needs the few classes and not the rows."""
    per = df.groupBy(*groups, *values).agg(F.count("*").alias("k"))
    w = Window.partitionBy(*groups).orderBy(*values)
    return per.withColumn("hi", F.sum("k").over(w)).withColumn("lo", F.col("hi") - F.col("k")).withColumn("n", F.sum("k").over(Window.partitionBy(*groups)))


def positions(df: DataFrame) -> DataFrame:
    """(s, y, at): the rows' positions from 0 in the order of (s, y). Only counts by score are ordered, in ranges."""
    per = df.groupBy("s").agg(F.count("*").alias("k"), F.sum(F.col("y").cast("long")).alias("pos"))
    per = M.running(per, [], "s", ["k"])
    zeros = F.struct(F.lit(0).alias("y"), F.col("k_before").alias("lo"), (F.col("k_before") + F.col("k") - F.col("pos")).alias("hi"))
    ones = F.struct(F.lit(1).alias("y"), (F.col("k_before") + F.col("k") - F.col("pos")).alias("lo"), (F.col("k_before") + F.col("k")).alias("hi"))
    classes = per.select("s", F.inline(F.array(zeros, ones))).where("lo < hi")
    return classes.select("s", "y", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("at"))


#: Levels of the tree over the ranks of distinct scores, of which there may be 2**LEVELS.
LEVELS = 24


def uniform(seed: int, *parts) -> Column:
    """A number between 0 and 1 from a hash of its place, the same in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def ln_factorial(x: Column) -> Column:
    """Exact up to 20, then Stirling's series, which is as good as doubles are from there on."""
    x = x.cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(6.283185307179586 * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(x <= 20, F.ln(F.factorial(F.least(x, F.lit(20.0)).cast("int")).cast("double"))).otherwise(series)


#: Terms that a draw's task holds at a time.
TERMS = 1 << 18


def terms_below(n: pa.Array, lo: pa.Array, hi: pa.Array, p: pa.Array, first: pa.Array, u: pa.Array) -> pa.Array:
    """How many running sums of the binomial terms lo to hi, the first of which is given, stay below u. Draws of about
    the same number of terms are rows of one array."""
    n, lo, hi, p, first, u = (c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in (n, lo, hi, p, first, u))
    width, out = (hi - lo).astype(np.int64) + 1, np.zeros(len(n), np.int64)
    order, at = np.argsort(width, kind="stable")[::-1], 0
    while at < len(order):
        most = width[order[at]]
        rows = order[at : at + max(1, TERMS // max(1, most))]
        at += len(rows)
        inside = (p[rows] > 0) & (p[rows] < 1)
        rows = rows[inside]
        k = lo[rows, None] + np.arange(most)
        mass = np.empty(k.shape)
        mass[:, 0] = first[rows]
        mass[:, 1:] = (p[rows] / (1 - p[rows]))[:, None] * (n[rows, None] - k[:, :-1]) / (k[:, :-1] + 1)
        below = np.cumsum(np.cumprod(mass, axis=1), axis=1) < u[rows, None]
        out[rows] = (below & (np.arange(most) < width[rows, None])).sum(axis=1)
    return pa.array(out)


def binomial(n: Column, a: Column, b: Column, u: Column) -> Column:
    """How many of n draws fall on the a of b, by inversion of the distribution at u. Terms beyond ten standard deviations
    are left out, so that the work is in proportion to the root of n."""
    p = a.cast("double") / b
    mean, spread = n * p, 10 * F.sqrt(n * p * (1 - p)) + 10
    lo, hi = F.greatest(F.lit(0), F.floor(mean - spread)), F.least(n, F.ceil(mean + spread))
    first = F.exp(ln_factorial(n) - ln_factorial(lo) - ln_factorial(n - lo) + lo * F.ln(p) + (n - lo) * F.ln(1 - p))
    drawn = F.least(n, lo + F.arrow_udf(terms_below, "bigint")(*(c.cast("double") for c in (n, lo, hi, p, first, u))))
    return F.when(a == 0, F.lit(0)).when(a == b, n).otherwise(drawn).cast("long")


def resamples(df: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """df (s, y), s in [0, 1] -> (replicate, s, y, w): each replicate draws as many rows as df has, with replacement.

    The draws are split down a binary tree over the ranks of the distinct scores, and at a score over the two outcomes: a
    node's draws fall to its halves by a binomial draw, so that the work is replicates times classes and not rows. The
    tree begins at the lowest node that holds all ranks; nodes are numbered as if it were LEVELS deep."""
    per = df.groupBy("s").agg(F.count("*").alias("k"), F.sum(F.col("y").cast("long")).alias("pos"))
    per = M.running(per.withColumn("one", F.lit(1)), [], "s", ["one"]).select("s", "k", "pos", F.col("one_before").alias("cell"))
    held = df.sparkSession.read.parquet(_written(per, "classes"))
    levels = held.select("k", F.explode(F.sequence(F.lit(1), F.lit(LEVELS))).alias("level"), "cell")
    levels = levels.select("level", "k", F.floor(F.col("cell") / F.pow(F.lit(2.0), LEVELS - F.col("level"))).cast("long").alias("child"))
    nodes = levels.groupBy("level", F.floor(F.col("child") / 2).alias("node")).agg(F.sum("k").alias("all"), F.sum(F.when(F.col("child") % 2 == 0, F.col("k")).otherwise(0)).alias("left"))
    nodes = df.sparkSession.read.parquet(_written(nodes, "nodes"))
    n, scores = held.agg(F.coalesce(F.sum("k"), F.lit(0)), F.count("*")).first()
    now = df.sparkSession.range(replicates if n else 0).select(F.col("id").alias("replicate"), F.lit(0).cast("long").alias("node"), F.lit(n).cast("long").alias("w"))
    for level in range(LEVELS + 1 - max(scores - 1, 0).bit_length(), LEVELS + 1):
        here = now.join(nodes.where(F.col("level") == level).drop("level"), "node")
        left = binomial(F.col("w"), F.col("left"), F.col("all"), uniform(seed, F.col("replicate"), level, F.col("node")))
        halves = here.withColumn("x", left).select("replicate", F.inline(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("x").alias("w")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("w") - F.col("x")).alias("w")))))
        now = halves.where("w > 0")
        if level % 5 == 0:  # cuts the plan, which would double with every level that Spark can't see through
            now = df.sparkSession.read.parquet(_written(now, "draws"))
    leaves = now.join(held.withColumnRenamed("cell", "node"), "node")
    ones = binomial(F.col("w"), F.col("pos"), F.col("k"), uniform(seed, F.col("replicate"), "y", F.col("node")))
    both = leaves.withColumn("x", ones).select("replicate", "s", F.inline(F.array(F.struct(F.lit(1).alias("y"), F.col("x").alias("w")), F.struct(F.lit(0).alias("y"), (F.col("w") - F.col("x")).alias("w")))))
    return both.where("w > 0")


def _written(df: DataFrame, name: str) -> str:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return path


def resampled_metrics(w: DataFrame) -> DataFrame:
    """Rate, ECE over ten bins, Brier score and AUC of each replicate of resamples(). The AUC is null where a replicate
    has one outcome class or one score."""
    y, k = F.col("y").cast("double"), F.col("w")
    base = w.groupBy("replicate").agg((F.sum(k * y) / F.sum(k)).alias("rate"), (F.sum(k * F.pow(F.col("s") - y, 2)) / F.sum(k)).alias("brier"), (F.min("s") < F.max("s")).alias("differ"))
    bins = w.groupBy("replicate", M.bin_of(F.col("s"), 10).alias("bin")).agg(F.sum(k).alias("n"), F.abs(F.sum(k * F.col("s")) - F.sum(k * y)).alias("gap"))
    ece = bins.groupBy("replicate").agg((F.sum("gap") / F.sum("n")).alias("ece"))
    per = w.groupBy("replicate", "s").agg(F.sum(k * F.col("y")).alias("pos"), F.sum(k * (1 - F.col("y"))).alias("neg"))
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    auc = M.running(per, ["replicate"], "s", ["pos", "neg"]).groupBy("replicate").agg(F.try_divide(wins, F.sum("pos") * F.sum("neg").cast("double")).alias("auc"))
    return base.join(ece, "replicate").join(auc, "replicate").select("replicate", "rate", "ece", "brier", F.when(F.col("differ"), F.col("auc")).alias("auc"))


def bootstrap_metrics(df: DataFrame, replicates: int = 500, seed: int = 0) -> DataFrame:
    """One row: 95% intervals of rate, ECE, Brier score and AUC, and the replicates that had an AUC."""
    per = resampled_metrics(resamples(df, replicates, seed))
    ends = [F.percentile(c, F.lit(p)).alias(f"{c}_{n}") for c in ("rate", "ece", "brier", "auc") for n, p in (("low", 0.025), ("high", 0.975))]
    return per.agg(*ends, F.count("auc").alias("usable"), F.count("*").alias("replicates"))


def bootstrap_yield(df: DataFrame, target_positive: int = 50, target_negative: int = 50, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """df (c), 'p', 'q' or else neither -> one row: intervals of both rates over resamples of all rows, the records that
    the targets imply at the observed and at the low rates, and the status.

    A resample is two binomial draws: its positives, and its negatives among the others."""
    n, p, q = df.agg(F.count("*"), F.coalesce(F.sum((F.col("c") == "p").cast("long")), F.lit(0)), F.coalesce(F.sum((F.col("c") == "q").cast("long")), F.lit(0))).first()
    size, rest = F.lit(n).cast("long"), F.lit(n - p).cast("long")
    picks = df.sparkSession.range(replicates if n else 0).select(F.col("id").alias("replicate"))
    picks = picks.withColumn("x", binomial(size, F.lit(p).cast("long"), size, uniform(seed, F.col("replicate"), "p")))
    picks = picks.withColumn("z", binomial(size - F.col("x"), F.lit(q).cast("long"), rest, uniform(seed, F.col("replicate"), "q")))
    rates = picks.select("replicate", (F.col("x") / n).alias("positive"), (F.col("z") / n).alias("negative")) if n else picks.select("replicate", F.lit(0.0).alias("positive"), F.lit(0.0).alias("negative"))
    ends = [F.percentile(c, F.lit(x)).alias(f"{c}_{e}") for c in ("positive", "negative") for e, x in (("low", 0.025), ("high", 0.975))]
    implied = lambda a, b: F.when((a > 0) & (b > 0), F.greatest(F.ceil(target_positive / a), F.ceil(target_negative / b)))
    status = "no_labeled_events" if not p + q else "no_positive_events" if not p else "no_negative_events" if not q else "estimable"
    rate = lambda k: F.lit(k / n if n else None).cast("double")
    out = rates.agg(F.count("*").alias("replicates"), *ends).select(F.lit(n).alias("n"), F.lit(p).alias("positives"), F.lit(q).alias("negatives"), "*")
    return out.select("*", implied(rate(p), rate(q)).alias("implied"), implied(F.col("positive_low"), F.col("negative_low")).alias("implied_low"), F.lit(status).alias("status"))


def ln_factorial_sql(x: str) -> str:
    x = f"({x})::double"
    return f"(CASE WHEN {x} <= 20 THEN ln(factorial(least({x}, 20)::int)::double) ELSE {x} * ln({x}) - {x} + 0.5 * ln(6.283185307179586 * {x}) + 1 / (12 * {x}) - 1 / (360 * {x} * {x} * {x}) + 1 / (1260 * {x} * {x} * {x} * {x} * {x}) END)"


def binomial_sql(source: str, keys: str, place: str, seed: int = 0) -> str:
    """A query over `source` with w draws, a and b: adds x as binomial() does. place: the text that is hashed after the seed."""
    return f"""SELECT t.* EXCLUDE (u, p, lo, hi), CASE WHEN a = 0 THEN 0 WHEN a = b THEN w ELSE x END::bigint AS x FROM (
   SELECT *, ((('0x' || substr(md5('{seed}:' || {place}), 1, 8))::bigint + 0.5) / 4294967296.0) AS u, a::double / b AS p,
          greatest(0, floor(w * (a::double / b) - 10 * sqrt(w * (a::double / b) * (1 - a::double / b)) - 10))::bigint AS lo, least(w, ceil(w * (a::double / b) + 10 * sqrt(w * (a::double / b) * (1 - a::double / b)) + 10))::bigint AS hi FROM {source}) t
  LEFT JOIN (SELECT {keys}, least(any_value(w), any_value(lo) + count(*) FILTER (below < u)) AS x FROM (
     SELECT *, sum(exp(whole - {ln_factorial_sql("j")} - {ln_factorial_sql("w - j")} + j * ln(p) + (w - j) * ln(1 - p))) OVER (PARTITION BY {keys} ORDER BY j ROWS UNBOUNDED PRECEDING) AS below FROM (
       SELECT *, {ln_factorial_sql("w")} AS whole, unnest(range(lo, hi + 1)) AS j FROM (
         SELECT *, ((('0x' || substr(md5('{seed}:' || {place}), 1, 8))::bigint + 0.5) / 4294967296.0) AS u, a::double / b AS p,
          greatest(0, floor(w * (a::double / b) - 10 * sqrt(w * (a::double / b) * (1 - a::double / b)) - 10))::bigint AS lo, least(w, ceil(w * (a::double / b) + 10 * sqrt(w * (a::double / b) * (1 - a::double / b)) + 10))::bigint AS hi FROM {source} WHERE a > 0 AND a < b))) GROUP BY {keys}) USING ({keys})"""


def tree_sql(rows: str, replicates: int, seed: int = 0) -> str:
    """The tree of resamples() over the CTE `rows` (s, y), a CTE a level; the last is resampled (replicate, s, y, w)."""
    out = [f"""classes AS (SELECT s, count(*) AS k, sum(y)::bigint AS pos, row_number() OVER (ORDER BY s) - 1 AS cell FROM {rows} GROUP BY s),
 level0 AS (SELECT r AS replicate, 0::bigint AS node, (SELECT sum(k) FROM classes)::bigint AS w FROM range({replicates}) t(r))"""]
    for level in range(1, LEVELS + 1):
        child = f"(cell >> {LEVELS - level})"
        out.append(f"""nodes{level} AS (SELECT {child} >> 1 AS node, sum(k)::bigint AS b, coalesce(sum(k) FILTER ({child} % 2 = 0), 0)::bigint AS a FROM classes GROUP BY 1),
 here{level} AS (SELECT * FROM level{level - 1} JOIN nodes{level} USING (node)), drawn{level} AS MATERIALIZED ({binomial_sql(f"here{level}", "replicate, node", f"replicate || ':{level}:' || node", seed)}),
 level{level} AS MATERIALIZED (SELECT replicate, node * 2 + side AS node, CASE side WHEN 0 THEN x ELSE w - x END AS w FROM drawn{level}, (VALUES (0), (1)) t(side) WHERE CASE side WHEN 0 THEN x ELSE w - x END > 0)""")
    out.append(f"""leaves AS (SELECT replicate, node, w, s, pos AS a, k AS b FROM level{LEVELS} JOIN classes ON cell = node), split AS MATERIALIZED ({binomial_sql("leaves", "replicate, node", "replicate || ':y:' || node", seed)}),
 resampled AS MATERIALIZED (SELECT replicate, s, y, CASE y WHEN 1 THEN x ELSE w - x END AS w FROM split, (VALUES (0), (1)) t(y) WHERE CASE y WHEN 1 THEN x ELSE w - x END > 0)""")
    return ",\n ".join(out)


BOOTMETRIC = f"""WITH {LABELLED}, quality AS (SELECT s, y FROM labelled WHERE family = 'quality' AND y IS NOT NULL), {tree_sql("quality", 500)},
 base AS (SELECT replicate, sum(w * y) / sum(w)::double AS rate, sum(w * pow(s - y, 2)) / sum(w) AS brier, min(s) < max(s) AS differ FROM resampled GROUP BY replicate),
 bins AS (SELECT replicate, {BIN_SQL} AS bin, sum(w) AS n, abs(sum(w * s) - sum(w * y)) AS gap FROM resampled GROUP BY ALL), ece AS (SELECT replicate, sum(gap) / sum(n) AS ece FROM bins GROUP BY replicate),
 per AS (SELECT replicate, s, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM resampled GROUP BY ALL), curve AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY replicate ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM per),
 auc AS (SELECT replicate, sum(pos * (nb + neg / 2.0))::double / nullif(sum(pos)::double * sum(neg)::double, 0) AS auc FROM curve GROUP BY replicate),
 x AS (SELECT rate, ece, brier, CASE WHEN differ THEN auc END AS auc FROM base JOIN ece USING (replicate) JOIN auc USING (replicate))
 SELECT {", ".join(f"round(quantile_cont({c}, {p}), 6) AS {c}_{n}" for c in ("rate", "ece", "brier", "auc") for n, p in (("low", 0.025), ("high", 0.975)))}, count(auc) AS usable, count(*) AS replicates FROM x"""


@query(BOOTMETRIC)
def a_bootmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-BOOTMETRIC as a whole: 500 resamples, each of all rows. m_bootmetric is a smaller one, of 300 draws."""
    done = bootstrap_metrics(labelled(spark, sf_dir).where("family = 'quality' AND y IS NOT NULL").select("s", "y"))
    return done.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in done.dtypes))


BOOTYIELD = f"""WITH o AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS p, count(*) FILTER (o_orderstatus = 'O') AS q FROM orders),
 first AS (SELECT r AS replicate, n AS w, p AS a, n AS b, q FROM o, range(2000) t(r)), positives AS MATERIALIZED ({binomial_sql("first", "replicate", "replicate || ':p'")}),
 second AS (SELECT replicate, w AS n, x AS found, w - x AS w, q AS a, b - a AS b FROM positives), negatives AS MATERIALIZED ({binomial_sql("second", "replicate", "replicate || ':q'")}),
 rates AS (SELECT found / n::double AS positive, x / n::double AS negative FROM negatives),
 ends AS (SELECT count(*) AS replicates, quantile_cont(positive, 0.025) AS pl, quantile_cont(positive, 0.975) AS ph, quantile_cont(negative, 0.025) AS nl, quantile_cont(negative, 0.975) AS nh FROM rates)
 SELECT n, p AS positives, q AS negatives, replicates, round(pl, 6) AS positive_low, round(ph, 6) AS positive_high, round(nl, 6) AS negative_low, round(nh, 6) AS negative_high,
  CASE WHEN p > 0 AND q > 0 THEN greatest(ceil(50 / (p / n::double)), ceil(50 / (q / n::double)))::bigint END AS implied, CASE WHEN pl > 0 AND nl > 0 THEN greatest(ceil(50 / pl), ceil(50 / nl))::bigint END AS implied_low,
  CASE WHEN p + q = 0 THEN 'no_labeled_events' WHEN p = 0 THEN 'no_positive_events' WHEN q = 0 THEN 'no_negative_events' ELSE 'estimable' END AS status FROM o, ends"""


@query(BOOTYIELD)
def a_bootyield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-BOOTYIELD as a whole: 2,000 resamples of all orders, both classes, with a status."""
    c = F.when(F.col("o_orderstatus") == "F", "p").when(F.col("o_orderstatus") == "O", "q").otherwise("z")
    done = bootstrap_yield(table(spark, sf_dir, "orders").select(c.alias("c")))
    return done.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in done.dtypes))


DRAWS = "draws AS (SELECT r AS replicate, d AS draw, ('0x' || substr(md5('0:' || r || ':' || d), 1, 8))::bigint AS h FROM range({reps}) a(r), range({n}) b(d))"


@query(f"""WITH o AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'p' WHEN 'O' THEN 'q' ELSE 'z' END AS c FROM orders), k AS (SELECT c, count(*) AS k FROM o GROUP BY c),
 cl AS (SELECT c, sum(k) OVER (ORDER BY c) - k AS lo, sum(k) OVER (ORDER BY c) AS hi, sum(k) OVER () AS n FROM k), {DRAWS.format(reps=400, n=200)},
 x AS (SELECT replicate, avg((c = 'p')::int) AS rate FROM draws JOIN cl ON h % n >= lo AND h % n < hi GROUP BY replicate)
 SELECT count(*) AS replicates, round(quantile_cont(rate, 0.025), 6) AS low, round(quantile_cont(rate, 0.5), 6) AS median, round(quantile_cont(rate, 0.975), 6) AS high, ceil(50 / quantile_cont(rate, 0.5))::bigint AS implied FROM x""")
def m_bootyield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """400 pilots of 200 draws from all orders: interval of the positive rate and the records that 50 positives imply."""
    c = F.when(F.col("o_orderstatus") == "F", "p").when(F.col("o_orderstatus") == "O", "q").otherwise("z")
    classes = classes_of(table(spark, sf_dir, "orders").select(c.alias("c")), [], ["c"])
    hit = drawn(draws(spark, 400, 200), F.broadcast(classes))
    rates = hit.groupBy("replicate").agg(F.avg((F.col("c") == "p").cast("int")).alias("rate"))
    q = rates.agg(F.count("*").alias("replicates"), F.percentile("rate", F.array(*map(F.lit, (0.025, 0.5, 0.975)))).alias("q"))
    return q.select("replicates", F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("median"), F.round(F.col("q")[2], 6).alias("high"), F.ceil(50 / F.col("q")[1]).alias("implied"))


@query(f"""WITH {LABELLED}, q AS (SELECT * FROM labelled WHERE family = 'quality'), k AS (SELECT s, y, count(*) AS k FROM q GROUP BY ALL),
 cl AS (SELECT s, y, sum(k) OVER (ORDER BY s, y) - k AS lo, sum(k) OVER (ORDER BY s, y) AS hi, sum(k) OVER () AS n FROM k), {DRAWS.format(reps=100, n=300)},
 x AS (SELECT replicate, avg(y) AS rate, avg(pow(s - y, 2)) AS brier FROM draws JOIN cl ON h % n >= lo AND h % n < hi GROUP BY replicate)
 SELECT round(quantile_cont(rate, 0.025), 6) AS rate_low, round(quantile_cont(rate, 0.975), 6) AS rate_high, round(quantile_cont(brier, 0.025), 6) AS brier_low, round(quantile_cont(brier, 0.975), 6) AS brier_high, count(*) AS usable FROM x""")
def m_bootmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 resamples of 300 scored rows: intervals of the rate and the Brier score."""
    rows = labelled(spark, sf_dir).where("family = 'quality'")
    hit = draws(spark, 100, 300).withColumn("at", F.col("h") % F.lit(rows.count())).join(positions(rows), "at")
    per = hit.groupBy("replicate").agg(F.avg("y").alias("rate"), F.avg(F.pow(F.col("s") - F.col("y"), 2)).alias("brier"))
    q = lambda c, p, n: F.round(F.percentile(c, F.lit(p)), 6).alias(n)
    return per.agg(q("rate", 0.025, "rate_low"), q("rate", 0.975, "rate_high"), q("brier", 0.025, "brier_low"), q("brier", 0.975, "brier_high"), F.count("*").alias("usable"))


@query("""SELECT user_id, ts::date::varchar AS day, round(quantile_cont(value, 0.99), 6) AS p99, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, count(*) AS requests FROM events GROUP BY ALL""")
def m_runstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency statistics of each run."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day"))
    return rows.agg(F.round(F.percentile("value", F.lit(0.99)), 6).alias("p99"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("requests"))
