"""The store of events, signals and outcomes: joins, referential checks, set operations, ranking and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.gates import lane_differences
from ..operators.intervals import covered_rows, interval_sums, micros
from ..operators.order import first_by_score, placed
from ..operators.upsert import orphans
from ..registry import query
from ..sources.store import EvidenceStore, scratch
from ..sources.tables import table
from .bindings import CORPUS, LABELLED, LANES, PROFILE, corpus, labelled, lanes

SIGNALS = """signals AS (SELECT event_id, user_id % 3 AS strategy, v AS version, least(value / 40, 1) AS score FROM events, (VALUES ('v1'), ('v2')) x(v) WHERE v = 'v1' OR event_id % 7 = 0)"""
OUTCOMES = """outcomes AS (SELECT CASE WHEN event_id % 101 = 0 THEN event_id + 10000000 ELSE event_id END AS event_id, user_id % 3 AS strategy, CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'v1' END AS version, event_type = 'error' AS occurred FROM events WHERE event_id % 3 = 0)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    versions = F.when(F.col("event_id") % 7 == 0, F.array(F.lit("v1"), F.lit("v2"))).otherwise(F.array(F.lit("v1")))
    return e.select("event_id", (F.col("user_id") % 3).alias("strategy"), F.explode(versions).alias("version"), F.least(F.col("value") / 40, F.lit(1.0)).alias("score"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_id % 3 = 0")
    i = F.col("event_id")
    return e.select(F.when(i % 101 == 0, i + 10_000_000).otherwise(i).alias("event_id"), (F.col("user_id") % 3).alias("strategy"), F.when(i % 9 != 0, "v1").alias("version"), (F.col("event_type") == "error").alias("occurred"))


KEYS = ["event_id", "strategy", "version"]


@query(f"WITH {SIGNALS}, {OUTCOMES} SELECT event_id, round(score, 6) AS score, occurred FROM signals JOIN outcomes USING (event_id, strategy, version)")
def j_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(score, outcome) pairs; repeated outcomes fan out."""
    return signals(spark, sf_dir).join(outcomes(spark, sf_dir), KEYS).select("event_id", F.round("score", 6).alias("score"), "occurred")


@query(f"WITH {SIGNALS}, {OUTCOMES}, m AS (SELECT o.event_id, count(s.version) AS matches FROM outcomes o LEFT JOIN signals s ON s.event_id = o.event_id AND s.strategy = o.strategy WHERE o.version IS NULL GROUP BY 1) SELECT * FROM m WHERE matches <> 1")
def j_ambig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes without a version that match no or several signal versions."""
    open_ones = outcomes(spark, sf_dir).where("version IS NULL").select("event_id", "strategy")
    matches = open_ones.join(signals(spark, sf_dir).select("event_id", "strategy", F.lit(1).alias("hit")), ["event_id", "strategy"], "left")
    return matches.groupBy("event_id").agg(F.count("hit").alias("matches")).where("matches <> 1")


@query(f"""WITH {SIGNALS}, {OUTCOMES}, one AS (SELECT event_id, strategy, min(version) AS single FROM signals GROUP BY ALL HAVING count(*) = 1)
 SELECT o.event_id, coalesce(version, single, CASE WHEN o.event_id % 14 = 0 AND o.event_id < 10000000 THEN 'v2' END) AS version, coalesce(version, single, CASE WHEN o.event_id % 14 = 0 AND o.event_id < 10000000 THEN 'v2' END) IS NULL AS unresolved FROM outcomes o LEFT JOIN one USING (event_id, strategy)""")
def j_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing versions filled where exactly one signal matches, then from an explicit repair table."""
    one = signals(spark, sf_dir).groupBy("event_id", "strategy").agg(F.min("version").alias("only"), F.count("*").alias("n")).where("n = 1").drop("n")
    repairs = table(spark, sf_dir, "events").where("event_id % 14 = 0").select("event_id", F.lit("v2").alias("repaired"))
    filled = outcomes(spark, sf_dir).join(one, ["event_id", "strategy"], "left").join(repairs, "event_id", "left")
    version = F.coalesce("version", "only", "repaired")
    return filled.select("event_id", version.alias("version"), version.isNull().alias("unresolved"))


@query(f"""WITH {SIGNALS}, {OUTCOMES} SELECT 'outcome without signal' AS rule, event_id::varchar AS key FROM outcomes WHERE event_id NOT IN (SELECT event_id FROM signals)
 UNION ALL SELECT 'line without order', l_orderkey::varchar FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'order without customer', o_custkey::varchar FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def j_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referential checks, one anti join a rule."""
    a = orphans(outcomes(spark, sf_dir), signals(spark, sf_dir), "event_id", "outcome without signal")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    b = orphans(lines, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), "k", "line without order")
    c = orphans(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k", "order without customer")
    return a.unionByName(b).unionByName(c)


@query(f"""WITH {CORPUS}, ids AS (SELECT row_id, 'fit' AS role FROM corpus WHERE split = 'calibration_fit' OR row_id % 503 = 0 UNION ALL SELECT row_id, 'gate' FROM corpus WHERE split = 'calibration_gate' OR row_id % 509 = 0 UNION ALL SELECT row_id + 100000000, 'gate' FROM corpus WHERE row_id % 1009 = 0)
 SELECT count(*) FILTER (WHERE c.row_id IS NULL) AS unknown, count(*) FILTER (WHERE role = 'fit' AND split <> 'calibration_fit') AS fit_outside, count(*) FILTER (WHERE role = 'gate' AND split <> 'calibration_gate') AS gate_outside,
  (SELECT count(*) FROM (SELECT row_id FROM ids GROUP BY 1 HAVING count(DISTINCT role) > 1)) AS shared FROM ids LEFT JOIN corpus c USING (row_id)""")
def j_calids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit and gate ids exist, lie in their splits and are disjoint."""
    c = corpus(spark, sf_dir).select("row_id", "split")
    role = lambda df, name: df.select("row_id", F.lit(name).alias("role"))
    ids = role(c.where("split = 'calibration_fit' OR row_id % 503 = 0"), "fit").unionAll(role(c.where("split = 'calibration_gate' OR row_id % 509 = 0"), "gate")).unionAll(c.where("row_id % 1009 = 0").select((F.col("row_id") + 100_000_000).alias("row_id"), F.lit("gate").alias("role")))
    n = lambda x: F.sum(F.when(x, 1).otherwise(0)).cast("long")
    agg = ids.join(c, "row_id", "left").agg(n(F.col("split").isNull()).alias("unknown"), n((F.col("role") == "fit") & (F.col("split") != "calibration_fit")).alias("fit_outside"), n((F.col("role") == "gate") & (F.col("split") != "calibration_gate")).alias("gate_outside"))
    shared = ids.groupBy("row_id").agg(F.min("role").alias("a"), F.max("role").alias("b")).where("a <> b").agg(F.count("*").alias("shared"))
    return agg.crossJoin(shared)


#: Microseconds in a quarter of an hour, the steps in which rows and intervals meet.
QUARTER = 900_000_000
ANCHORS = """anchors AS (SELECT user_id AS anchor, min(ts) + INTERVAL 6 HOURS AS start, min(ts) + INTERVAL 30 HOURS AS stop FROM events WHERE user_id % 5 = 0 GROUP BY user_id UNION ALL SELECT -1, TIMESTAMP '2030-01-01', TIMESTAMP '2030-01-02')"""


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named intervals; the last one covers nothing."""
    e = table(spark, sf_dir, "events").where("user_id % 5 = 0").groupBy(F.col("user_id").alias("anchor")).agg(F.min("ts").alias("t"))
    some = e.select("anchor", (F.col("t") + F.expr("INTERVAL 6 HOURS")).alias("start"), (F.col("t") + F.expr("INTERVAL 30 HOURS")).alias("stop"))
    return some.unionAll(spark.sql("SELECT CAST(-1 AS BIGINT), TIMESTAMP_NTZ '2030-01-01', TIMESTAMP_NTZ '2030-01-02'"))


def timed_anchors(spark: SparkSession, sf_dir: str, margin: str = "0 HOURS") -> DataFrame:
    """The anchors with lo and hi, the microseconds that they cover with a margin on both sides."""
    a = anchors(spark, sf_dir).withColumn("_lo", F.col("start") - F.expr(f"INTERVAL {margin}")).withColumn("_hi", F.col("stop") + F.expr(f"INTERVAL {margin}"))
    return a.withColumn("lo", micros(a, "_lo")).withColumn("hi", micros(a, "_hi")).drop("_lo", "_hi")


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "value", micros(e, "ts").alias("_at"))


def covered(spark: SparkSession, sf_dir: str, margin: str = "0 HOURS") -> DataFrame:
    """The pairs of rows and anchors' intervals that hold them."""
    return covered_rows(timed_events(spark, sf_dir).drop("value"), timed_anchors(spark, sf_dir, margin), QUARTER)


@query(f"WITH {ANCHORS} SELECT anchor, count(event_id) AS n, round(coalesce(avg(value), 0), 6) AS mean FROM anchors LEFT JOIN events ON ts BETWEEN start AND stop GROUP BY anchor")
def j_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per interval; intervals without rows stay."""
    sums = {"n": F.when(F.col("event_id").isNotNull(), 1).otherwise(0), "k": F.when(F.col("value").isNotNull(), 1).otherwise(0), "total": F.col("value")}
    per = interval_sums(timed_events(spark, sf_dir), timed_anchors(spark, sf_dir), "anchor", sums).select("anchor", "n", F.try_divide("total", "k").alias("mean"))
    out = anchors(spark, sf_dir).select("anchor").join(per, "anchor", "left")
    return out.select("anchor", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean"))


@query(f"WITH {ANCHORS} SELECT anchor, event_id, ts BETWEEN start AND stop AS inside FROM anchors JOIN events ON ts BETWEEN start - INTERVAL 6 HOURS AND stop + INTERVAL 6 HOURS")
def j_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within six hours of an interval."""
    return covered(spark, sf_dir, "6 HOURS").select("anchor", "event_id", F.col("ts").between(F.col("start"), F.col("stop")).alias("inside"))


@query("""WITH u AS (SELECT l_orderkey AS unit, max(l_linenumber) AS last_cycle, row_number() OVER (ORDER BY l_orderkey) AS pos FROM lineitem GROUP BY 1), v AS (SELECT o_custkey % 7 AS rul, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders)
 SELECT unit, last_cycle::int AS last_cycle, rul FROM u JOIN v USING (pos)""")
def j_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th value belongs to the n-th unit; positions are counts of the ranges before plus the place inside one."""
    units = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("unit")).agg(F.max("l_linenumber").alias("last_cycle"))
    values = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("rul"))
    return placed(units, "unit").join(placed(values, "o_orderkey"), "pos").select("unit", "last_cycle", "rul")


@query("""WITH k AS (SELECT DISTINCT user_id, ts::date AS day FROM events), r AS (SELECT user_id, ts::date AS day, event_id % 3 AS run, max(event_type) AS status, bool_or(event_type = 'error') AS label, count(*) AS artifacts FROM events GROUP BY ALL),
 j AS (SELECT k.user_id, k.day, count(run) AS runs, count(DISTINCT status) AS statuses, count(DISTINCT label) AS labels, count(DISTINCT artifacts) AS sizes FROM k LEFT JOIN r USING (user_id, day) GROUP BY ALL)
 SELECT user_id, count(*) AS keys, sum((runs < 3)::int)::bigint AS missing, sum((statuses > 1)::int)::bigint AS status_disagrees, sum((labels > 1)::int)::bigint AS label_disagrees, sum((sizes > 1)::int)::bigint AS artifact_disagrees FROM j GROUP BY user_id""")
def j_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs compared per key: missing runs and disagreements in status, label and artifacts."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), (F.col("event_id") % 3).alias("run"), "event_type")
    r = e.groupBy("user_id", "day", "run").agg(F.max("event_type").alias("status"), F.bool_or(F.col("event_type") == "error").alias("label"), F.count("*").alias("artifacts"))
    differ = lambda c: (F.min(c) != F.max(c)).cast("long")
    per = r.groupBy("user_id", "day").agg(F.count("*").alias("runs"), differ("status").alias("s"), differ("label").alias("l"), differ("artifacts").alias("a"))
    return per.groupBy("user_id").agg(F.count("*").alias("keys"), F.sum((F.col("runs") < 3).cast("long")).alias("missing"), F.sum("s").alias("status_disagrees"), F.sum("l").alias("label_disagrees"), F.sum("a").alias("artifact_disagrees"))


@query(f"""WITH {CORPUS}, rows_ AS (SELECT row_id, outcome, horizon FROM corpus WHERE row_id % 11 <> 0), caps AS (SELECT row_id, outcome, CASE WHEN row_id % 13 = 0 THEN 'hx' ELSE horizon END AS horizon FROM corpus WHERE row_id % 17 <> 0)
 SELECT row_id, r.row_id IS NULL AS no_row, c.row_id IS NULL AS no_capture, coalesce(r.outcome IS DISTINCT FROM c.outcome OR r.horizon IS DISTINCT FROM c.horizon, false) AS differs FROM (SELECT *, row_id AS k FROM rows_) r FULL JOIN (SELECT *, row_id AS k FROM caps) c USING (row_id)
 WHERE r.k IS NULL OR c.k IS NULL OR r.horizon IS DISTINCT FROM c.horizon""".replace("r.row_id IS NULL AS no_row, c.row_id IS NULL", "r.k IS NULL AS no_row, c.k IS NULL"))
def j_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every accepted row has one matching capture with equal fields; only the others are returned."""
    c = corpus(spark, sf_dir).select("row_id", "outcome", "horizon")
    rows = c.where("row_id % 11 <> 0").select("row_id", F.struct("outcome", "horizon").alias("r"))
    caps = c.where("row_id % 17 <> 0").withColumn("horizon", F.when(F.col("row_id") % 13 == 0, "hx").otherwise(F.col("horizon"))).select("row_id", F.struct("outcome", "horizon").alias("c"))
    both = rows.join(caps, "row_id", "full")
    return both.select("row_id", F.col("r").isNull().alias("no_row"), F.col("c").isNull().alias("no_capture"), (~F.col("r").eqNullSafe(F.col("c"))).alias("differs")).where("differs")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected keys without any terminal record."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query(f"WITH {CORPUS}, g AS (SELECT grp, count(DISTINCT split) AS splits, count(*) AS n FROM corpus GROUP BY grp) SELECT grp, splits, n FROM g WHERE splits > 1")
def j_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose rows lie in more than one split."""
    return corpus(spark, sf_dir).groupBy("grp").agg(F.count_distinct("split").alias("splits"), F.count("*").alias("n")).where("splits > 1")


@query("""WITH w AS (SELECT user_id, ts::date AS day, bool_or(event_type = 'error' AND hour(ts) < 12) AS short, bool_or(event_type = 'error') AS long FROM events GROUP BY ALL)
 SELECT count(*) AS n, sum(short::int)::bigint AS short_positives, sum(long::int)::bigint AS long_positives, bool_and(NOT short OR long) AS implied FROM w""")
def j_implies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows under two windows: every short-window positive is a long-window one."""
    bad = F.col("event_type") == "error"
    w = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.bool_or(bad & (F.hour("ts") < 12)).alias("short"), F.bool_or(bad).alias("long"))
    return w.agg(F.count("*").alias("n"), F.sum(F.col("short").cast("long")).alias("short_positives"), F.sum(F.col("long").cast("long")).alias("long_positives"), F.bool_and(~F.col("short") | F.col("long")).alias("implied"))


@query(f"WITH {CORPUS}, {LANES} SELECT row_id, differing, differing = '' AS matches FROM lanes")
def j_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each capture's seven lane fields against the frozen profile."""
    differing = F.array_join(lane_differences(PROFILE), ",")
    return lanes(spark, sf_dir).select("row_id", differing.alias("differing"), (differing == "").alias("matches"))


@query(f"WITH {SIGNALS} SELECT event_id, version FROM signals WHERE event_id % 200 NOT IN (SELECT p_partkey % 150 FROM part)")
def j_defresolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores whose definition id cannot be resolved."""
    known = table(spark, sf_dir, "part").select((F.col("p_partkey") % 150).alias("definition")).distinct()
    return signals(spark, sf_dir).withColumn("definition", F.col("event_id") % 200).join(known, "definition", "left_anti").select("event_id", "version")


@query(f"WITH {SIGNALS} SELECT event_id, count(DISTINCT version) AS versions, CASE WHEN count(DISTINCT version) > 1 THEN 'version required' ELSE 'ok' END AS status FROM signals WHERE event_id BETWEEN 100 AND 200 GROUP BY 1")
def flt_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals by key; a read without a version fails where there are several."""
    rows = signals(spark, sf_dir).where("event_id BETWEEN 100 AND 200").groupBy("event_id").agg(F.count_distinct("version").alias("versions"))
    return rows.withColumn("status", F.when(F.col("versions") > 1, "version required").otherwise("ok"))


@query("SELECT event_id, [x for x in [CASE WHEN value < 0.5 THEN 'value too small' END, CASE WHEN user_id % 50 = 0 THEN 'resource blank' END, CASE WHEN event_type NOT IN ('click', 'error', 'view') THEN 'unknown type' END] if x IS NOT NULL]::varchar AS violations FROM events".replace("::varchar", "").replace("AS violations", "AS v").join(["SELECT event_id, array_to_string(v, '; ') AS violations, len(v) = 0 AS valid FROM (", ")"]))
def flt_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row contract of events: all violations, in order, and whether the row is valid."""
    from ..functions.scores import violations

    v = violations((F.col("value") < 0.5, "value too small"), (F.col("user_id") % 50 == 0, "resource blank"), (~F.col("event_type").isin("click", "error", "view"), "unknown type"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(v, "; ").alias("violations"), (F.size(v) == 0).alias("valid"))


@query(f"WITH {CORPUS} SELECT row_id, outcome FROM corpus WHERE outcome <> 'censored'")
def flt_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).where("outcome <> 'censored'").select("row_id", "outcome")


@query(f"WITH {LABELLED} SELECT id, family, s FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY s DESC, id) AS rn FROM labelled) WHERE rn <= 20")
def k_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 20 of each family by (-score, id)."""
    w = Window.partitionBy("family").orderBy(F.desc("s"), "id")
    return labelled(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 20").select("id", "family", "s")


@query(f"""WITH {LABELLED}, g AS (SELECT *, row_number() OVER (ORDER BY s DESC, id, family) AS gr, row_number() OVER (PARTITION BY family ORDER BY s DESC, id) AS lr, count(*) OVER () AS gn, count(*) OVER (PARTITION BY family) AS ln FROM labelled)
 SELECT family, count(*) FILTER (WHERE gr <= ceil(0.2 * gn)) AS in_global, count(*) FILTER (WHERE lr <= ceil(0.2 * ln)) AS in_local, count(*) FILTER (WHERE gr <= ceil(0.2 * gn) AND lr <= ceil(0.2 * ln)) AS in_both FROM g GROUP BY family""")
def k_globallocal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The global top fifth against each family's own. Both are first parts of a family's own order, by score and then id,
    so that the smaller one is what they share."""
    rows = labelled(spark, sf_dir)
    top = first_by_score(rows, 0.2, ["id", "family"], {"in_global": F.lit(1)}, ("family",)).select("family", "in_global")
    own = rows.groupBy("family").agg(F.ceil(F.lit(0.2) * F.count("*")).alias("in_local")).join(top, "family", "left")
    in_global = F.coalesce("in_global", F.lit(0))
    return own.select("family", in_global.alias("in_global"), "in_local", F.least(in_global, "in_local").alias("in_both"))


@query(f"""WITH {LABELLED}, p AS (SELECT y FROM (SELECT y, row_number() OVER (ORDER BY s DESC, id, family) AS rn FROM labelled) WHERE rn <= 40), f AS (SELECT family, avg(y) AS precision FROM (SELECT family, y, row_number() OVER (PARTITION BY family ORDER BY s DESC, id) AS rn FROM labelled) WHERE rn <= 20 GROUP BY 1)
 SELECT round(avg(precision), 6) AS macro_precision, round((SELECT avg(y) FROM p), 6) AS pooled_precision, round(avg(precision) - (SELECT avg(y) FROM p), 6) AS degradation FROM f""")
def k_harm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ranking two families in one list costs: pooled top 2k precision against the mean of each family's top k."""
    rows = labelled(spark, sf_dir)
    pooled = rows.orderBy(F.desc("s"), "id", "family").limit(40).agg(F.avg("y").alias("pooled"))
    w = Window.partitionBy("family").orderBy(F.desc("s"), "id")
    own = rows.withColumn("rn", F.row_number().over(w)).where("rn <= 20").groupBy("family").agg(F.avg("y").alias("p")).agg(F.avg("p").alias("macro"))
    return own.crossJoin(pooled).select(F.round("macro", 6).alias("macro_precision"), F.round("pooled", 6).alias("pooled_precision"), F.round(F.col("macro") - F.col("pooled"), 6).alias("degradation"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def s_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return a.unionByName(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")))


@query("SELECT o_custkey AS id FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' INTERSECT SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
def s_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderdate")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return o.where(F.col("o_orderdate") < at("1996-01-01")).select("id").intersect(o.where(F.col("o_orderdate") >= at("2000-01-01")).select("id"))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def s_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")))


@query("WITH a AS (SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT') (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL (SELECT id FROM b EXCEPT SELECT id FROM a)")
def s_symdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rule changes in a selection, in one aggregation over both sides."""
    o = table(spark, sf_dir, "orders")
    per = o.groupBy(F.col("o_custkey").alias("id")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("a"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("b"))
    return per.where("a <> b").select("id")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'insert' WHEN event_id % 50 = 1 THEN 'conflict' ELSE 'same' END AS action, CASE WHEN event_id % 4 <> 0 AND event_id % 50 = 1 THEN 'conflict' ELSE 'same' END AS again, value FROM events""")
def s_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second batch against a stored one: new, equal, or in conflict; and the same batch once more under another name.
    The value is the stored one: a conflict leaves it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    batch = e.withColumn("value", F.when(F.col("event_id") % 50 == 1, F.col("value") + 1).otherwise(F.col("value")))
    store = EvidenceStore(spark, scratch(spark, "upsert"), slots=16)
    store.apply("events", e.where("event_id % 4 <> 0"), "first")
    plan = store.apply("events", batch, "second").select("event_id", "action")
    again = store.apply("events", batch, "third").select("event_id", F.col("action").alias("again"))
    return plan.join(again, "event_id").join(store.read("events").select("event_id", "value"), "event_id")


@query("SELECT 'rule ' || (event_id % 6) AS message, min(event_id) AS first_row, count(*) AS n FROM events WHERE value < 3 GROUP BY 1")
def s_uniqerr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct error messages, each with the first row that raised it."""
    rows = table(spark, sf_dir, "events").where("value < 3").select(F.concat(F.lit("rule "), (F.col("event_id") % 6).cast("string")).alias("message"), "event_id")
    return rows.groupBy("message").agg(F.min("event_id").alias("first_row"), F.count("*").alias("n"))


STORED = f"""
WITH {SIGNALS}, s AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'gone' ELSE 'd' || strategy END AS definition_id FROM signals WHERE event_id % 4 <> 3),
{OUTCOMES}, kept AS (SELECT * FROM s WHERE definition_id <> 'gone'), versions AS (SELECT event_id, strategy, count(*) AS n, bool_or(version = 'v1') AS first FROM kept GROUP BY ALL),
o AS (SELECT o.*, n, first FROM outcomes o LEFT JOIN versions USING (event_id, strategy))
SELECT 'events' AS stored, 'insert' AS action, '' AS reason, count(*) AS n FROM events
UNION ALL SELECT 'events', 'conflict', '', count(*) FROM events WHERE event_id % 50 = 1
UNION ALL SELECT 'events', 'same', '', count(*) FROM events WHERE event_id % 50 <> 1
UNION ALL SELECT 'definitions', 'insert', '', count(DISTINCT user_id % 3) FROM events
UNION ALL SELECT 'signals', CASE definition_id WHEN 'gone' THEN 'rejected' ELSE 'insert' END, CASE definition_id WHEN 'gone' THEN 'unknown definition' ELSE '' END, count(*) FROM s GROUP BY ALL
UNION ALL SELECT 'outcomes', CASE WHEN n IS NULL OR version IS NULL AND n > 1 THEN 'rejected' ELSE 'insert' END, CASE WHEN n IS NULL THEN 'no signal' WHEN version IS NULL AND n > 1 THEN 'a version is required' ELSE '' END, count(*) FROM o GROUP BY ALL
UNION ALL SELECT 'stored ' || x, '', '', n FROM (SELECT 'events' AS x, count(*) AS n FROM events UNION ALL SELECT 'signals', count(*) FROM kept UNION ALL SELECT 'outcomes', count(*) FROM o WHERE n = 1 OR n > 1 AND version IS NOT NULL)"""


@query(STORED)
def src_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store of events, definitions, signals and outcomes: written in order, the events once more with conflicts, and
    what became of each row; then the rows that the tables hold."""
    store = EvidenceStore(spark, scratch(spark, "kb"), slots=16)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    store.apply("events", e, "first")
    store.apply("events", e.withColumn("value", F.when(F.col("event_id") % 50 == 1, F.col("value") + 1).otherwise(F.col("value"))), "second")
    named = F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string"))
    store.apply("definitions", e.select(named.alias("definition_id")).distinct().withColumn("event", F.lit("error")), "first")
    scored = signals(spark, sf_dir).where("event_id % 4 <> 3")
    meant = F.concat(F.lit("d"), F.col("strategy").cast("string"))
    store.apply("signals", scored.withColumn("definition_id", F.when(F.col("event_id") % 13 == 0, "gone").otherwise(meant)), "first")
    store.apply("outcomes", outcomes(spark, sf_dir).withColumn("definition_id", meant), "first")
    out = None
    for name in ("events", "definitions", "signals", "outcomes"):
        rows = store.ledger(name).groupBy(F.lit(name).alias("stored"), "action", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.sum("times").alias("n"))
        out = rows if out is None else out.unionAll(rows)
        if name != "definitions":
            out = out.unionAll(store.read(name).agg(F.count("*").alias("n")).select(F.lit(f"stored {name}"), F.lit(""), F.lit(""), "n"))
    return out
