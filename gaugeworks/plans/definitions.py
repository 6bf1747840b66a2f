"""Outcome definitions derived from suppliers and parts: canonical keys, comparison, registration and label sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.definitions import FIELDS, canonical, compared
from ..operators.upsert import upsert_plan
from ..registry import query
from ..sources.tables import table

CANON = """canon AS (SELECT p_partkey AS id, p_brand AS brand, lower(trim(p_type)) AS event, 'poll:interval=' || (p_size % 3) || ',path=/' AS process, (7 + p_size % 2 * 7) || ' day deploy' AS "window",
 'error_rate > ' || (p_size % 2) || ' 5 minute,latency >= ' || (p_size % 4) || ' 5 minute' AS thresholds FROM part)"""


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One definition a part, with stray capitals and blanks and with parameters and thresholds in either order."""
    size = F.col("p_size")
    one = lambda m, op, v: F.struct(F.lit(m).alias("metric"), F.lit(op).alias("operator"), v.cast("string").alias("value"), F.lit(5).alias("sustain"), F.lit("Minute").alias("unit"))
    a, b = one(" Latency", ">=", size % 4), one("error_rate ", ">", size % 2)
    odd = F.col("p_partkey") % 2 == 1
    params = F.when(odd, F.create_map(F.lit("Path "), F.lit("/"), F.lit("interval"), (size % 3).cast("string"))).otherwise(F.create_map(F.lit("interval"), (size % 3).cast("string"), F.lit("path"), F.lit("/")))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.concat(F.col("p_type"), F.lit(" ")).alias("event"), F.lit("Poll").alias("kind"), params.alias("params"),
        (7 + size % 2 * 7).alias("duration"), F.lit(" Day").alias("unit"), F.lit("deploy").alias("anchor"), F.when(odd, F.array(a, b)).otherwise(F.array(b, a)).alias("thresholds"),
    )


@query(f"WITH {CANON} SELECT id, event, process, \"window\", thresholds FROM canon")
def fn_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(definitions(spark, sf_dir))


@query(f"""WITH {CANON}, k AS (SELECT event, process, "window", thresholds, count(*) AS n, min(id) AS id FROM canon GROUP BY ALL), p AS (
 SELECT a.id AS first, b.id AS second, a.n * b.n AS pairs, [x for x in [CASE WHEN a.event <> b.event THEN 'event' END, CASE WHEN a.process <> b.process THEN 'process' END, CASE WHEN a."window" <> b."window" THEN 'window' END, CASE WHEN a.thresholds <> b.thresholds THEN 'thresholds' END] if x IS NOT NULL] AS d FROM k a JOIN k b ON a.id < b.id)
 SELECT first, second, pairs, CASE WHEN len(d) = 0 THEN 'direct' WHEN list_has_any(d, ['event', 'process']) THEN 'irreducible' ELSE 'bridgeable' END AS relation, array_to_string(d, ',') AS differing FROM p""")
def j_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of different definitions, each once. Equal definitions are one class with its count, so the pairs
    are those of distinct keys, which a catalogue has few of."""
    keys = canonical(definitions(spark, sf_dir)).groupBy("event", "process", "window", "thresholds").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    pairs = compared(keys.drop("n"), keys.drop("n"), F.col("a_id") < F.col("b_id"))
    n = keys.select("id", "n")
    return pairs.join(n.selectExpr("id AS first", "n AS na"), "first").join(n.selectExpr("id AS second", "n AS nb"), "second").select("first", "second", (F.col("na") * F.col("nb")).alias("pairs"), "relation", "differing")


def relation_classes(canon: DataFrame, group: str) -> DataFrame:
    """canon: canonical definitions with a group column -> each definition's classes and how many others of its group
    stand in each relation to it, which is the whole comparison of pairs without the pairs.

    Definitions of one direct_class are equal and may pool; those of one bridge_class have event and process in common
    and differ in window_only, thresholds_only or both; all others of the group are irreducible. Definitions are counted
    by distinct key first, so a hot group is joined as its distinct keys."""
    keys = canon.groupBy(group, *FIELDS).agg(F.count("*").alias("n"), F.min("id").alias("direct_class"))
    levels = {"all": [group], "bridge": [group, "event", "process"], "same_window": [group, "event", "process", "window"], "same_thresholds": [group, "event", "process", "thresholds"]}
    for name, by in levels.items():
        more = [F.min("direct_class").alias("bridge_class")] if name == "bridge" else []
        keys = keys.join(keys.groupBy(*by).agg(F.sum("n").alias(name), *more), by)
    c = F.col
    counts = {
        "direct": c("n") - 1, "window_only": c("same_thresholds") - c("n"), "thresholds_only": c("same_window") - c("n"),
        "both": c("bridge") - c("same_window") - c("same_thresholds") + c("n"), "irreducible": c("all") - c("bridge"),
    }
    keys = keys.select(group, *FIELDS, "direct_class", "bridge_class", *(v.alias(k) for k, v in counts.items()))
    return canon.join(keys, [group, *FIELDS]).select("id", group, "direct_class", "bridge_class", *counts, (c("direct") > 0).alias("may_pool"))


@query(f"""WITH {CANON}, w AS (SELECT id, brand, min(id) OVER k AS direct_class, min(id) OVER p AS bridge_class, count(*) OVER k AS n, count(*) OVER p AS np, count(*) OVER (PARTITION BY brand, event, process, "window") AS nw, count(*) OVER (PARTITION BY brand, event, process, thresholds) AS nt, count(*) OVER (PARTITION BY brand) AS nb
 FROM canon WINDOW k AS (PARTITION BY brand, event, process, "window", thresholds), p AS (PARTITION BY brand, event, process))
 SELECT id, brand, direct_class, bridge_class, n - 1 AS direct, nt - n AS window_only, nw - n AS thresholds_only, np - nw - nt + n AS "both", nb - np AS irreducible, n > 1 AS may_pool FROM w""")
def g_commens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All definitions of a brand against each other: direct, bridgeable or irreducible; only direct ones may pool."""
    d = definitions(spark, sf_dir)
    return relation_classes(canonical(d).join(d.select("id", "brand"), "id"), "brand")


@query(f"""WITH {CANON}, s AS (SELECT brand, count(*) AS definitions, count(DISTINCT event) AS events, avg((id % 5 = 0)::int) > 0.2 AS lacks_licence, bool_and(id % 3 <> 0) AS retained FROM canon GROUP BY brand)
 SELECT brand, definitions, events, CASE WHEN lacks_licence THEN 'blocked' WHEN NOT retained THEN 'inconclusive' ELSE 'reproduced' END AS status FROM s""")
def g_labelsem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each label source: blocked where more than a fifth of its definitions lack a licence, inconclusive where
    some were not retained, or reproduced."""
    d = definitions(spark, sf_dir).select("id", "brand")
    s = canonical(definitions(spark, sf_dir)).join(d, "id").groupBy("brand").agg(F.count("*").alias("definitions"), F.count_distinct("event").alias("events"), (F.avg((F.col("id") % 5 == 0).cast("int")) > 0.2).alias("x"), F.bool_and(F.col("id") % 3 != 0).alias("retained"))
    return s.select("brand", "definitions", "events", F.when(F.col("x"), "blocked").when(~F.col("retained"), "inconclusive").otherwise("reproduced").alias("status"))


def label_comparison(sources: DataFrame, canon: DataFrame) -> DataFrame:
    """sources (source, id, available, licence, current, bridged) and their canonical definitions -> a row a pair of
    sources with the comparison and its reason, and the report's status. Sources are few and declared by hand."""
    c = F.col
    status = F.when(~c("available") | (F.trim(F.coalesce("licence", F.lit(""))) == ""), "blocked").when(~c("current"), "inconclusive").otherwise("reproduced")
    s = sources.select("source", "id", status.alias("status"), "bridged")
    a, b = (s.select(*(c(x).alias(f"{p}_{x}") for x in s.columns)) for p in ("a", "b"))
    of = canon.join(s.select("id"), "id", "left_semi")
    pairs = compared(of, of, c("a_id") != c("b_id")).join(a, c("first") == c("a_id")).join(b, c("second") == c("b_id")).where("a_source < b_source")
    missing = (c("a_status") != "reproduced") | (c("b_status") != "reproduced")
    reason = (
        F.when(c("a_status") != "reproduced", F.concat(F.lit("first source is "), c("a_status"))).when(c("b_status") != "reproduced", F.concat(F.lit("second source is "), c("b_status")))
        .when((c("relation") == "bridgeable") & ~(c("a_bridged") & c("b_bridged")), "bridge evidence is required").otherwise(c("differing"))
    )
    rows = pairs.select(c("a_source").alias("first"), c("b_source").alias("second"), F.when(missing, "unavailable").otherwise(c("relation")).alias("comparison"), F.when(missing, "").otherwise(c("differing")).alias("differing"), reason.alias("reason"))
    worst = s.agg(F.bool_or(c("status") == "blocked").alias("x"), F.bool_or(c("status") == "inconclusive").alias("y"))
    lost = rows.agg(F.coalesce(F.bool_or(c("comparison") == "unavailable"), F.lit(False)).alias("z"))
    report = F.when(c("x") | c("z"), "blocked").when(c("y"), "inconclusive").otherwise("reproduced")
    return rows.join(F.broadcast(worst)).join(F.broadcast(lost)).select(*rows.columns, report.alias("report"))


@query(f"""WITH {CANON}, s AS (SELECT brand AS source, c.*, CASE WHEN c.id % 11 = 0 OR c.id % 5 = 0 THEN 'blocked' WHEN c.id % 7 = 0 THEN 'inconclusive' ELSE 'reproduced' END AS status, c.id % 2 = 0 AS bridged FROM canon c WHERE id IN (SELECT min(id) FROM canon GROUP BY brand)),
 p AS (SELECT a.source AS first, b.source AS second, a.status AS sa, b.status AS sb, a.bridged AND b.bridged AS bridged, a.status <> 'reproduced' OR b.status <> 'reproduced' AS missing,
  [x for x in [CASE WHEN a.event <> b.event THEN 'event' END, CASE WHEN a.process <> b.process THEN 'process' END, CASE WHEN a."window" <> b."window" THEN 'window' END, CASE WHEN a.thresholds <> b.thresholds THEN 'thresholds' END] if x IS NOT NULL] AS d FROM s a JOIN s b ON a.source < b.source),
 r AS (SELECT *, CASE WHEN len(d) = 0 THEN 'direct' WHEN list_has_any(d, ['event', 'process']) THEN 'irreducible' ELSE 'bridgeable' END AS relation FROM p)
 SELECT first, second, CASE WHEN missing THEN 'unavailable' ELSE relation END AS comparison, CASE WHEN missing THEN '' ELSE array_to_string(d, ',') END AS differing,
  CASE WHEN sa <> 'reproduced' THEN 'first source is ' || sa WHEN sb <> 'reproduced' THEN 'second source is ' || sb WHEN relation = 'bridgeable' AND NOT bridged THEN 'bridge evidence is required' ELSE array_to_string(d, ',') END AS reason,
  CASE WHEN (SELECT bool_or(status = 'blocked') FROM s) OR bool_or(missing) OVER () THEN 'blocked' WHEN (SELECT bool_or(status = 'inconclusive') FROM s) THEN 'inconclusive' ELSE 'reproduced' END AS report FROM r""")
def g_labelpairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label sources (a brand, with its first definition) compared with each other, the second half of G-LABELSEM."""
    d = definitions(spark, sf_dir)
    k = F.col("id")
    first = d.groupBy("brand").agg(F.min("id").alias("id"))
    sources = first.select(F.col("brand").alias("source"), "id", (k % 11 != 0).alias("available"), F.when(k % 5 != 0, "CC-BY").alias("licence"), (k % 7 != 0).alias("current"), (k % 2 == 0).alias("bridged"))
    return label_comparison(sources, canonical(d))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'insert' WHEN p_partkey % 7 = 0 AND p_size % 2 = 0 THEN 'conflict' ELSE 'same' END AS action FROM part")
def s_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registering definitions again: new ids, equal content, or the same id with other content."""
    stored = canonical(definitions(spark, sf_dir))
    batch = definitions(spark, sf_dir).withColumn("duration", F.when(F.col("id") % 7 == 0, 14).otherwise(F.col("duration")))
    return upsert_plan(stored.where("id % 10 <> 0"), canonical(batch), "id")
