"""Scalar scoring, validation and labelling expressions over the driver's tables."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.canonical import identity
from ..registry import query
from ..sources.tables import table
from .bindings import CORPUS, SPLITS, corpus

CHANGES = """
changes AS (
  SELECT o.o_orderkey AS change_ref, any_value(o.o_orderdate) AS ts, any_value(o.o_custkey) AS author, sum(l.l_quantity) AS added, count(*) * 10.0::double AS removed,
         count(DISTINCT p.p_brand) AS files, bool_or(p.p_brand LIKE 'Brand#1%') AS fragile
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey GROUP BY o.o_orderkey)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events: orders with their parts' brands as the files touched."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    per = lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy("l_orderkey").agg(F.sum("l_quantity").alias("added"), (F.count("*") * 10.0).alias("removed"), F.collect_set("p_brand").alias("paths"))
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS change_ref", "o_orderdate AS ts", "o_custkey AS author")
    return orders.join(per, orders.change_ref == per.l_orderkey).drop("l_orderkey")


@query(f"WITH {CHANGES} SELECT change_ref, round(1 - exp(-0.002::double * (added + removed)), 9) AS risk FROM changes")
def fn_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).select("change_ref", F.round(S.churn_risk(F.col("added") + F.col("removed")), 9).alias("risk"))


@query(f"""WITH {CHANGES}, t AS (SELECT *, added + removed AS churn, change_ref % 24 AS hour FROM changes)
 SELECT change_ref, round(least(1.0, CASE WHEN churn > 200 THEN 0.35 WHEN churn > 50 THEN 0.15 ELSE 0 END + CASE WHEN files > 8 THEN 0.2 ELSE 0 END + CASE WHEN fragile THEN 0.3 ELSE 0 END + CASE WHEN hour >= 22 OR hour <= 5 THEN 0.15 ELSE 0 END)::double, 6) AS risk,
  concat_ws('; ', CASE WHEN churn > 200 THEN 'very large change' WHEN churn > 50 THEN 'large change' END, CASE WHEN files > 8 THEN 'many files' END, CASE WHEN fragile THEN 'fragile path' END, CASE WHEN hour >= 22 OR hour <= 5 THEN 'late hour' END) AS reasons FROM t""")
def fn_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders have no time of day, so the hour is taken from the key."""
    rows = changes(spark, sf_dir)
    parts = (F.col("added") + F.col("removed"), F.size("paths"), F.col("paths"), F.col("change_ref") % 24, ("Brand#1",))
    return rows.select("change_ref", F.round(S.change_risk(*parts), 6).alias("risk"), S.change_reasons(*parts).alias("reasons"))


@query("SELECT event_id, round(least(1, 0.5 * least(value / 30000 / 0.02, 1) + 0.5 * least(value / 60000 / 0.01, 1)), 9) AS risk FROM events")
def fn_res(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(S.resource_risk(F.col("value") / 30000, F.col("value") / 60000), 9).alias("risk"))


HISTORY = "h AS (SELECT user_id % 10 AS job, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1)"


@query(f"""WITH {HISTORY} SELECT event_id, round(CASE WHEN value IS NULL OR n IS NULL OR n < 5 THEN 0 ELSE 1 / (1 + exp(-(abs(value - mean) / CASE WHEN std = 0 THEN 1 ELSE std END - 2))) END, 6) AS score
 FROM events LEFT JOIN h ON h.job = user_id % 10 WHERE ts >= TIMESTAMP '2024-01-15'""")
def fn_anom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later runs against the history of their job type."""
    rows = table(spark, sf_dir, "events").withColumn("job", F.col("user_id") % 10)
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    history = rows.where(F.col("ts") < cut).groupBy("job").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"))
    late = rows.where(F.col("ts") >= cut).join(history, "job", "left")
    return late.select("event_id", F.round(S.history_anomaly(F.col("value"), F.col("mean"), F.col("std"), F.col("n")), 6).alias("score"))


@query(f"WITH {HISTORY} SELECT e.event_id, h.job, h.n, round(h.mean, 6) AS mean, round(h.std, 6) AS std FROM events e JOIN h ON h.job = e.user_id % 10")
def j_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job type's history statistics on its runs; the statistics have one row a job type."""
    rows = table(spark, sf_dir, "events").withColumn("job", F.col("user_id") % 10)
    history = rows.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).groupBy("job").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.count("*").alias("n"))
    return rows.select("event_id", "job").join(history, "job")


@query("""SELECT event_id, regexp_matches(t, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?Z$') AS public_form, regexp_matches(t, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?(Z|\\+00:00)$') AS admission_form,
 regexp_matches(t, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?(Z|[+-]00:00)$') AS event_form
 FROM (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 5 WHEN 0 THEN 'Z' WHEN 1 THEN '+00:00' WHEN 2 THEN '-00:00' WHEN 3 THEN '+02:00' ELSE '' END AS t FROM events)""")
def fn_rfc3339(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three accepted timestamp forms: Z only, Z or +00:00, and any zero offset."""
    zone = F.element_at(F.array(*map(F.lit, ("Z", "+00:00", "-00:00", "+02:00", ""))), (F.col("event_id") % 5 + 1).cast("int"))
    t = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    stem = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?"
    ok = F.try_to_timestamp(t).isNotNull()
    return table(spark, sf_dir, "events").select("event_id", (t.rlike(stem + "Z$") & ok).alias("public_form"), (t.rlike(stem + r"(Z|\+00:00)$") & ok).alias("admission_form"), (t.rlike(stem + "(Z|[+-]00:00)$") & ok).alias("event_form"))


@query("SELECT event_id, t, CASE WHEN regexp_matches(t, '(Z|[+-]\\d{2}:?\\d{2})$') THEN NULL ELSE try_cast(t AS timestamp) END AS naive FROM (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN event_id % 7 = 0 THEN 'Z' ELSE '' END AS t FROM events)")
def fn_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps with a zone are rejected (null), all others are read as naive."""
    t = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("event_id") % 7 == 0, "Z").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", t.alias("t"), F.when(~t.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), t.try_cast("timestamp_ntz")).alias("naive"))


@query("SELECT o_orderkey, year(o_orderdate)::int AS year, year(o_orderdate) <> 1995 + o_orderkey % 7 AS mismatch FROM orders")
def fn_epochyear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The UTC year of an epoch second against a stored year."""
    epoch = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    year = F.year(F.timestamp_seconds(epoch))
    return table(spark, sf_dir, "orders").select("o_orderkey", year.alias("year"), (year != 1995 + F.col("o_orderkey") % 7).alias("mismatch"))


@query("SELECT p_partkey, regexp_matches(code, '^[LMH]\\d{5}$') AS product_ok, regexp_matches(sha, '^[0-9a-f]{40}$') AS commit_ok FROM (SELECT p_partkey, upper(substr(p_name, 1, 1)) || lpad(p_partkey::varchar, 5, '0') AS code, md5(p_name) || CASE WHEN p_partkey % 3 = 0 THEN 'g0000000' ELSE substr(md5(p_brand), 1, 8) END AS sha FROM part)")
def fn_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.upper(F.substring("p_name", 1, 1)), F.lpad(F.col("p_partkey").cast("string"), 5, "0"))
    sha = F.concat(F.md5("p_name"), F.when(F.col("p_partkey") % 3 == 0, "g0000000").otherwise(F.substring(F.md5("p_brand"), 1, 8)))
    return table(spark, sf_dir, "part").select("p_partkey", code.rlike(r"^[LMH]\d{5}$").alias("product_ok"), sha.rlike("^[0-9a-f]{40}$").alias("commit_ok"))


@query("""SELECT p_partkey, v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) AS finite, coalesce(v = floor(v) AND NOT isinf(v) AND NOT isnan(v), false) AS whole, coalesce(v BETWEEN 0 AND 1000 AND NOT isnan(v), false) AS in_range
 FROM (SELECT p_partkey, try_cast(CASE p_partkey % 6 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN 'x' ELSE p_retailprice::varchar END AS double) AS v FROM part)""")
def fn_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 6 == 0, "NaN").when(F.col("p_partkey") % 6 == 1, "Infinity").when(F.col("p_partkey") % 6 == 2, "x").otherwise(F.col("p_retailprice").cast("string"))
    v = text.try_cast("double")
    rows = table(spark, sf_dir, "part").select("p_partkey", v.alias("v"))
    v = F.col("v")
    return rows.select("p_partkey", S.finite(v).alias("finite"), F.coalesce((v == F.floor(v)) & S.finite(v), F.lit(False)).alias("whole"), F.coalesce(v.between(0, 1000), F.lit(False)).alias("in_range"))


WIDE = {"train": ("1995-01-01", "1998-01-01"), "calibration_fit": ("1998-01-01", "1998-07-01"), "calibration_gate": ("1998-07-01", "1999-01-01"), "test": ("1999-01-01", "2001-01-01")}


def case_sql(bounds: dict, end: str, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN o_orderdate >= TIMESTAMP '{a}' AND o_orderdate {end} TIMESTAMP '{b}' THEN '{n}'" for n, (a, b) in bounds.items()) + f" ELSE {otherwise} END"


@query(f"SELECT o_orderkey, {case_sql(WIDE, '<', chr(39) + 'outside' + chr(39))} AS split FROM orders")
def fn_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", S.half_open_split(F.col("o_orderdate"), WIDE).alias("split"))


@query(f"SELECT o_orderkey, {case_sql(WIDE, '<=', 'NULL')} AS split FROM orders")
def fn_split_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends belong to a range; on a shared end the first range wins."""
    return table(spark, sf_dir, "orders").select("o_orderkey", S.closed_split(F.col("o_orderdate"), WIDE).alias("split"))


@query(f"WITH {CORPUS} SELECT row_id, CASE outcome WHEN 'observed_positive' THEN 1 WHEN 'observed_negative' THEN 0 END::double AS label FROM corpus")
def fn_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("row_id", S.label_of(F.col("outcome")).cast("double").alias("label"))


THRESHOLDS = "thr AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '>' ELSE '>=' END AS op, (s_suppkey % 50)::double AS bound FROM supplier)"


@query(f"""WITH {THRESHOLDS}, r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, op, bound, CASE WHEN op = '>' THEN l_quantity > bound ELSE l_quantity >= bound END AS resolved, l_returnflag = 'R' AS declared FROM lineitem JOIN thr ON s_suppkey = l_suppkey)
 SELECT op, resolved, count(*) AS n, sum((declared <> resolved)::int)::bigint AS mismatches FROM r GROUP BY ALL""")
def fn_thresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes resolved from a metric, its declared operator and bound, against the declared outcome."""
    thr = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, ">").otherwise(">=").alias("op"), (F.col("s_suppkey") % 50).cast("double").alias("bound"))
    rows = table(spark, sf_dir, "lineitem").join(thr, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.withColumn("resolved", F.when(F.col("op") == ">", F.col("l_quantity") > F.col("bound")).otherwise(F.col("l_quantity") >= F.col("bound")))
    return rows.groupBy("op", "resolved").agg(F.count("*").alias("n"), F.sum(((F.col("l_returnflag") == "R") != F.col("resolved")).cast("long")).alias("mismatches"))


@query("""WITH r AS (SELECT user_id, event_id, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, value, event_id) AS rn FROM events)
 SELECT user_id, round(max(CASE WHEN rn = 1 THEN least(1, 0.5 * least(value / 30000 / 0.02, 1) + 0.5 * least(value / 60000 / 0.01, 1)) END), 9) AS score, coalesce(bool_or(value / 30000 > 0.005) FILTER (WHERE rn > 1), false) AS outcome, count(*) AS observations
 FROM r GROUP BY user_id HAVING count(*) > 1""")
def fn_followup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score from a job's first observation, outcome from any later one; jobs with a single observation are left out.

    The first observation is a map-side combined minimum; every other row then only asks whether it is that one."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts")
    key = F.struct("ts", "value", "event_id")
    crosses = F.col("value") / 30000 > 0.005
    per = rows.groupBy("user_id").agg(F.min(key).alias("first"), F.count("*").alias("observations"), F.sum(crosses.cast("long")).alias("crossing")).where("observations > 1")
    later = F.col("crossing") - (F.col("first.value") / 30000 > 0.005).cast("long") > 0
    return per.select("user_id", F.round(S.resource_risk(F.col("first.value") / 30000, F.col("first.value") / 60000), 9).alias("score"), later.alias("outcome"), "observations")


TERMINAL_SQL = "CASE WHEN outcome = 'observed_positive' THEN 'observed_positive' WHEN outcome = 'observed_negative' THEN 'observed_negative' WHEN lower(coalesce(censor_reason, '')) LIKE '%window%' THEN 'censored' ELSE 'failed' END"


@query(f"WITH {CORPUS} SELECT row_id, {TERMINAL_SQL} AS status FROM corpus")
def fn_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of four terminal states for each capture."""
    status = F.when(F.col("outcome").isin("observed_positive", "observed_negative"), F.col("outcome")).when(F.lower(F.coalesce("censor_reason", F.lit(""))).contains("window"), "censored").otherwise("failed")
    return corpus(spark, sf_dir).select("row_id", status.alias("status"))


@query(f"""WITH {CORPUS} SELECT row_id, CASE WHEN NOT built THEN 'upstream build missing' WHEN NOT linked THEN 'deployment not linked' WHEN NOT monitored THEN 'monitoring incomplete' WHEN NOT window_complete THEN 'window incomplete' END AS reason,
 CASE WHEN built AND linked AND monitored AND window_complete AND outcome <> 'censored' THEN outcome ELSE 'censored' END AS outcome FROM corpus""")
def fn_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first missing piece of evidence, in order, and the outcome that is left."""
    reason = S.first_reason((~F.col("built"), "upstream build missing"), (~F.col("linked"), "deployment not linked"), (~F.col("monitored"), "monitoring incomplete"), (~F.col("window_complete"), "window incomplete"))
    rows = corpus(spark, sf_dir).withColumn("reason", reason)
    return rows.select("row_id", "reason", F.when(F.col("reason").isNull(), F.col("outcome")).otherwise("censored").alias("outcome"))


@query("""SELECT p.page_id, kind, CASE WHEN kind = 'html' AND p.page_id % 7 = 0 THEN 'missing' WHEN kind = 'html' AND p.page_id % 11 = 0 THEN 'unreadable' ELSE 'collected' END AS state,
 CASE WHEN kind = 'html' AND (p.page_id % 7 = 0 OR p.page_id % 11 = 0) THEN NULL ELSE sha256(CASE WHEN kind = 'html' THEN html ELSE url END) END AS digest,
 CASE WHEN kind = 'html' AND (p.page_id % 7 = 0 OR p.page_id % 11 = 0) THEN NULL ELSE strlen(CASE WHEN kind = 'html' THEN html ELSE url END)::double END AS byte_count
 FROM pages p, (VALUES ('html'), ('url')) k(kind)""")
def fn_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared artifacts against what was delivered: missing, unreadable, or collected with digest and size."""
    pages = table(spark, sf_dir, "pages")
    declared = pages.select("page_id", F.explode(F.array(F.lit("html"), F.lit("url"))).alias("kind"))
    html = pages.where("page_id % 7 <> 0").select("page_id", F.lit("html").alias("kind"), F.when(F.col("page_id") % 11 != 0, F.col("html")).alias("body"))
    delivered = html.unionByName(pages.select("page_id", F.lit("url").alias("kind"), F.col("url").alias("body"))).withColumn("delivered", F.lit(True))
    both = declared.join(delivered, ["page_id", "kind"], "left")
    state = F.when(F.col("delivered").isNull(), "missing").when(F.col("body").isNull(), "unreadable").otherwise("collected")
    return both.select("page_id", "kind", state.alias("state"), F.sha2("body", 256).alias("digest"), F.octet_length("body").cast("double").alias("byte_count"))


@query("SELECT page_id, starts_with(url, 'https://') AND NOT contains(url, '@') AND NOT contains(url, '?token=') AS public FROM pages")
def fn_pubref(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", (u.startswith("https://") & ~u.contains("@") & ~u.contains("?token=")).alias("public"))


@query("""WITH c AS (SELECT c_custkey, c_mktsegment, c_nationkey, count(o_orderkey) AS n, sum((o_orderstatus = 'F')::int) AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
 SELECT c_mktsegment AS segment, sum(p)::bigint AS positives, CASE WHEN sum(p) = 0 THEN NULL ELSE ceil(50 / (sum(p)::double / sum(n)))::bigint END AS implied FROM c GROUP BY 1""")
def fn_implied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records needed for 50 positives at the observed rate; null when there are none."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").cast("long").alias("p"))
    per = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")).join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    agg = per.groupBy("segment").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("positives"), F.count("p").alias("n"))
    return agg.select("segment", "positives", F.when(F.col("positives") > 0, F.ceil(50 / (F.col("positives") / F.col("n")))).alias("implied"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_./-]+')) AS token FROM documents) SELECT doc_id, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens FROM t GROUP BY doc_id""")
def fn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_./-]+"), 0)
    rows = table(spark, sf_dir, "documents").select("doc_id", tokens.alias("t")).where(F.size("t") > 0)
    return rows.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"))


MAPS = """maps AS (SELECT event_id, ts, [x for x in ['value', 'kind', CASE WHEN event_id % 31 = 0 THEN 'future' END, CASE WHEN event_id % 37 = 0 THEN 'outcome' END] if x IS NOT NULL] AS keys,
 [x for x in ['value', CASE WHEN event_id % 41 <> 0 THEN 'kind' END, CASE WHEN event_id % 31 = 0 THEN 'future' END, CASE WHEN event_id % 37 = 0 THEN 'outcome' END] if x IS NOT NULL] AS seen,
 event_id % 43 = 0 AS late FROM events)"""


def field_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as prediction fields with the time at which each field was observed."""
    e = table(spark, sf_dir, "events")
    entry = lambda k, v, on=None: F.when(F.lit(True) if on is None else on, F.struct(F.lit(k).alias("key"), v.alias("value")))
    value = F.col("value")
    some = lambda *xs: F.map_from_entries(F.filter(F.array(*xs), lambda x: x.isNotNull()))
    i = F.col("event_id")
    at = F.when(i % 43 == 0, F.col("ts") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("ts"))
    return e.select(
        "event_id", "ts", some(entry("value", value), entry("kind", F.length("event_type").cast("double")), entry("future", value, i % 31 == 0), entry("outcome", value, i % 37 == 0)).alias("fields"),
        some(entry("value", at), entry("kind", at, i % 41 != 0), entry("future", at, i % 31 == 0), entry("outcome", at, i % 37 == 0)).alias("observed_at"),
    )


@query(f"WITH {MAPS} SELECT event_id, list_has_any(keys, ['future']) AS beyond_allowed, list_has_any(keys, ['outcome']) AS forbidden, list_sort(keys) = list_sort(seen) AS keys_agree FROM maps")
def fn_mapkeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys beyond the allowed ones, forbidden keys, and agreement of the two maps' keys."""
    k, seen = F.map_keys("fields"), F.map_keys("observed_at")
    allowed = F.array(F.lit("value"), F.lit("kind"), F.lit("outcome"))
    return field_maps(spark, sf_dir).select(
        "event_id", (F.size(F.array_except(k, allowed)) > 0).alias("beyond_allowed"), F.arrays_overlap(k, F.array(F.lit("outcome"))).alias("forbidden"), (F.sort_array(k) == F.sort_array(seen)).alias("keys_agree")
    )


@query(f"WITH {MAPS} SELECT event_id, NOT late AS in_time FROM maps")
def fn_maptime(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.exists(F.map_values("observed_at"), lambda x: x > F.col("ts"))
    return field_maps(spark, sf_dir).select("event_id", (~late).alias("in_time"))


@query(f"WITH {CHANGES}, l AS (SELECT l_orderkey, count(*) AS lines, count(DISTINCT p_brand) AS brands FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) SELECT l_orderkey AS change_ref, lines > 0 AS filled, lines = brands AS unique_paths, true AS safe FROM l JOIN orders ON o_orderkey = l_orderkey")
def fn_arruniq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path lists that are filled, free of repeats, and safe (relative, without ..)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    per = lines.groupBy("l_orderkey").agg(F.collect_list("p_brand").alias("paths")).join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    unsafe = F.exists("paths", lambda p: p.rlike(r"^/|(^|/)\.\.(/|$)"))
    return per.select(F.col("l_orderkey").alias("change_ref"), (F.size("paths") > 0).alias("filled"), (F.size("paths") == F.size(F.array_distinct("paths"))).alias("unique_paths"), (~unsafe).alias("safe"))


PAYLOADS = """payloads AS (SELECT event_id, CASE WHEN event_id % 23 = 0 THEN '{"k": ' WHEN event_id % 3 = 0 THEN left(props, length(props) - 1) || ', "note": null, "ext": {"b": [1, 2.5], "a": "x"}}' ELSE props END AS stored,
 json_extract(props, '$.k')::bigint AS k FROM events)"""


@query(f"""WITH {PAYLOADS}, v AS (SELECT *, json_valid(stored) AS valid, k + CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END AS k2 FROM payloads)
 SELECT count(*) AS n, count(*) FILTER (WHERE NOT valid) AS malformed, sum(CASE WHEN valid THEN json_extract(CASE WHEN valid THEN stored END, '$.k')::bigint END)::bigint AS k_total, count(*) FILTER (WHERE valid) AS round_trips, count(*) FILTER (WHERE valid AND k = k2) AS matches,
 count(*) FILTER (WHERE json_extract(CASE WHEN valid THEN stored END, '$.ext.b[1]')::double = 2.5) AS extensions, count(*) FILTER (WHERE json_type(CASE WHEN valid THEN stored END, '$.note') = 'NULL') AS nulls FROM v""")
def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of any fields read from JSON, written back and read again: extension fields and nulls are kept, a payload
    equals another whatever the order of its keys, and malformed ones are counted."""
    i, k = F.col("event_id"), F.get_json_object("props", "$.k")
    more = i % 3 == 0
    stored = F.when(i % 23 == 0, '{"k": ').when(more, F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "note": null, "ext": {"b": [1, 2.5], "a": "x"}}'))).otherwise(F.col("props"))
    other = F.concat(F.when(more, '{"ext": {"a": "x", "b": [1, 2.5]}, "note": null, "k": ').otherwise('{"k": '), (k.cast("long") + F.when(i % 19 == 0, 1).otherwise(0)).cast("string"), F.lit("}"))
    once = F.to_json(F.try_parse_json(stored))  # the keys of a variant are sorted
    rows = table(spark, sf_dir, "events").select(once.alias("a"), F.to_json(F.try_parse_json(other)).alias("other"))
    again = F.try_parse_json("a")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return rows.agg(
        F.count("*").alias("n"), n(F.col("a").isNull()).alias("malformed"), F.sum(F.try_variant_get(again, "$.k", "bigint")).alias("k_total"), n(F.to_json(again) == F.col("a")).alias("round_trips"), n(F.col("a") == F.col("other")).alias("matches"),
        n(F.try_variant_get(again, "$.ext.b[1]", "double") == 2.5).alias("extensions"), n(F.is_variant_null(F.try_variant_get(again, "$.note", "variant"))).alias("nulls"),
    )


@query("SELECT event_id, round(least(1, greatest(0, value / 40 - 0.1)), 9) AS calibrated, CASE WHEN value / 40 - 0.1 < 0 OR value / 40 - 0.1 > 1 THEN 'clamped' ELSE 'calibrated' END AS status FROM events")
def fn_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("value") / 40 - 0.1
    return table(spark, sf_dir, "events").select("event_id", F.round(S.clamp(raw), 9).alias("calibrated"), F.when((raw < 0) | (raw > 1), "clamped").otherwise("calibrated").alias("status"))


STATE_SQL = "SELECT user_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min_by(value, event_id) AS first, max_by(value, event_id) AS last, round((max_by(value, event_id) - min_by(value, event_id)) / greatest(count(*) - 1, 1), 9) AS slope FROM events GROUP BY user_id"


@query(STATE_SQL)
def fn_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of each resource's window: mean, deviation, first, last and slope."""
    first, last = F.min_by("value", "event_id"), F.max_by("value", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), first.alias("first"), last.alias("last"), F.round((last - first) / F.greatest(F.count("*") - 1, F.lit(1)), 9).alias("slope"))


LATENT_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 50 = 7 THEN list_append(embedding::double[], 0.5) WHEN vec_id % 50 = 9 THEN NULL ELSE embedding::double[] END AS v FROM embeddings),
 h AS (SELECT vec_id, v IS NOT NULL AND len(v) > 0 AND len(v) % 2 = 0 AS ok, v[1:len(v) // 2] AS pre, v[len(v) // 2 + 1:] AS post FROM v),
 e AS (SELECT vec_id, ok, CASE WHEN ok THEN list_sum([pow(post[i] - pre[i] / 2, 2) for i in range(1, len(pre) + 1)]) / len(pre) END AS error, CASE WHEN ok THEN list_sum([pre[i] * ((i * 7) % 11 - 5) / 10 for i in range(1, len(pre) + 1)]) END AS z FROM h)
 SELECT vec_id, ok, round(error / (error + avg(error) OVER ()), 6) AS anomaly, round(1 / (1 + exp(-z)), 6) AS risk FROM e"""


def latent_scores(vectors: DataFrame, key: str) -> DataFrame:
    """vectors (key, v): a state before and after, as halves of one array -> (key, ok, anomaly, risk).

    The state after is predicted as half of the one before; anomaly is e / (e + scale) of its mean squared error e, with
    the mean error of all vectors as scale, and risk the sigmoid of a fixed readout of the state before. An array that is
    null, empty, of odd length or not finite is not ok and gets neither."""
    v, half = F.col("v"), F.expr("size(v) div 2")
    ok = F.coalesce(v.isNotNull() & (F.size("v") > 0) & (F.size("v") % 2 == 0) & F.forall(v, S.finite), F.lit(False))
    rows = vectors.select(key, ok.alias("ok"), F.when(ok, F.slice(v, F.lit(1), half)).alias("pre"), F.when(ok, F.slice(v, half + 1, half)).alias("post"))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    error = add(F.zip_with("post", "pre", lambda b, a: F.pow(b - a / 2, 2))) / F.size("pre")
    readout = add(F.transform("pre", lambda x, i: x * (((i + 1) * 7) % 11 - 5) / 10))
    rows = rows.select(key, "ok", error.alias("error"), readout.alias("z"))
    scale = F.broadcast(rows.agg(F.avg("error").alias("scale")))
    return rows.join(scale).select(key, "ok", F.try_divide(F.col("error"), F.col("error") + F.col("scale")).alias("anomaly"), (1 / (1 + F.exp(-F.col("z")))).alias("risk"))


@query(LATENT_SQL)
def fn_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latent error and risk readout of state vectors, of which some are null or of odd length."""
    i, v = F.col("vec_id"), F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(i % 50 == 7, F.array_append(v, F.lit(0.5))).when(i % 50 != 9, v).alias("v"))
    return latent_scores(rows, "vec_id").withColumn("anomaly", F.round("anomaly", 6)).withColumn("risk", F.round("risk", 6))


def projection(rows: int, columns: int, seed: str = "projection") -> list[list[float]]:
    """A fixed Gaussian matrix scaled by the root of its rows. Two hashes a weight give a normal number."""
    def weight(i: int, k: int) -> float:
        a, b = (int.from_bytes(hashlib.sha256(f"{seed}:{rows}:{columns}:{i}:{k}:{n}".encode()).digest()[:6], "big") for n in (1, 2))
        return math.sqrt(-2 * math.log((a + 1) / 2**48)) * math.cos(2 * math.pi * b / 2**48) / math.sqrt(rows)

    return [[weight(i, k) for i in range(rows)] for k in range(columns)]


def projected(df: DataFrame, vector: str, columns: int = 8) -> DataFrame:
    """Adds p0, p1, ...: each row's projection by the matrix of its width; null for a null, empty or broken vector. The
    matrices are made once, one for each width there is."""
    v, size = F.col(vector), F.size(vector)
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    widths = sorted(r[0] for r in df.where(size > 0).select(size).distinct().collect())
    made = df.sparkSession.createDataFrame([(n, projection(n, columns)) for n in widths], "_width int, _matrix array<array<double>>")
    dot = lambda k: F.aggregate(F.zip_with(v, F.col("_matrix")[k], lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    out = df.withColumn("_width", size).join(F.broadcast(made), "_width", "left")
    return out.select(*df.columns, *(F.when(fine & F.col("_matrix").isNotNull(), dot(k)).alias(f"p{k}") for k in range(columns)))


@query()
def fn_proj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed Gaussian random projection to eight dimensions, a row a vector."""
    done = projected(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "v")
    return done.select("vec_id", *(F.round(f"p{k}", 6).alias(f"p{k}") for k in range(8)))


HASHVEC_SQL = """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_./-]+')) AS t FROM documents), h AS (SELECT doc_id, ('0x' || substr(sha256(t), 1, 8))::bigint AS v FROM t),
 b AS (SELECT doc_id, v % 32 AS bucket, sum(CASE WHEN (v // 32) % 2 = 0 THEN 1 ELSE -1 END)::double AS x FROM h GROUP BY ALL), n AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS norm FROM b)
 SELECT doc_id, bucket, round(CASE WHEN norm > 0 THEN x / norm ELSE 0 END, 9) AS x FROM n"""


@query(HASHVEC_SQL)
def fn_hashvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed feature hashing of a document's tokens into 32 buckets, scaled to length 1. The buckets are 32 sums of one
    aggregation, so tokens are combined where they are read and one row a document is exchanged."""
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_./-]+"), 0)).alias("t"))
    hashed = tokens.select("doc_id", F.conv(F.substring(F.sha2("t", 256), 1, 8), 16, 10).cast("long").alias("h"))
    signed = hashed.select("doc_id", (F.col("h") % 32).alias("slot"), F.when(F.floor(F.col("h") / 32) % 2 == 0, 1.0).otherwise(-1.0).alias("sign"))
    slots = signed.groupBy("doc_id").agg(*(F.sum(F.when(F.col("slot") == k, F.col("sign"))).alias(f"x{k}") for k in range(32)))
    sums = slots.select("doc_id", F.array(*(f"x{k}" for k in range(32))).alias("xs"))
    norm = F.sqrt(F.aggregate("xs", F.lit(0.0), lambda a, x: a + F.coalesce(x * x, F.lit(0.0))))
    each = sums.select("doc_id", norm.alias("norm"), F.posexplode("xs").alias("bucket", "x")).where("x IS NOT NULL")
    return each.select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round(F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(0.0), 9).alias("x"))


HASH_SQL = r"""SELECT o_orderkey, sha256('{"by":{"customer":' || o_custkey || ',"priority":"' || replace(o_orderpriority, '-', '\\\\') || '"},"lines":[' || CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '{"late":' || (o_orderkey % 2 = 0) || ',"total":' || regexp_replace(o_totalprice::varchar, '\.0$', '') || '}' END
 || '],"small":' || CASE WHEN o_orderkey % 3 = 0 THEN '1e-7' ELSE '0.25' END || ',"status":"' || o_orderstatus || '\"\n","tags":{"a":"1","z":"' || o_orderkey || '"}}') AS identity FROM orders"""


@query(HASH_SQL)
def fn_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content identity of nested records with structs, lists, maps, numbers and signs to escape; the fields of half of
    them are in another order, which does not change it."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    line = F.when(k % 5 != 0, F.struct(F.col("o_totalprice").alias("total"), (k % 2 == 0).alias("late")))
    by = [F.regexp_replace("o_orderpriority", "-", r"\\\\").alias("priority"), F.col("o_custkey").alias("customer")]
    small = F.when(k % 3 == 0, F.lit(1e-7)).otherwise(F.lit(0.25)).alias("small")
    status = F.concat("o_orderstatus", F.lit('"\n')).alias("status")
    tags = [F.lit("z"), k.cast("string"), F.lit("a"), F.lit("1")]
    one = F.struct(status, F.array(line).alias("lines"), small, F.struct(*by).alias("by"), F.create_map(*tags).alias("tags"))
    two = F.struct(F.create_map(*tags[2:], *tags[:2]).alias("tags"), F.struct(*by[::-1]).alias("by"), F.array(line).alias("lines"), small, status)
    both = o.select("o_orderkey", one.alias("one"), two.alias("two"))
    same = F.when(k % 2 == 0, identity(F.col("one"), both.schema["one"].dataType)).otherwise(identity(F.col("two"), both.schema["two"].dataType))
    return both.select("o_orderkey", same.alias("identity"))
