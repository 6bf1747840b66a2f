"""Gates over corpora, captures and reports. Each is one Spark job that ends in a small report or a table of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import identity
from ..functions.scores import BIN_SQL, first_reason
from ..operators.gates import counts_grid, failed_rows, gate_report, manifest_error, terminal_records, worst
from ..operators.metrics import reliability, running
from ..operators.order import at_ranks
from ..registry import query
from ..sources.store import scratch
from ..sources.tables import table
from .bindings import CORPUS, LANES, PROFILE, SCORED, SPLITS, corpus, lanes, scored

CLASSES = ["observed_positive", "observed_negative", "censored"]
FLOOR = 50
FOREIGN_SHARE = 0.014
#: The one system that rows of the corpus may come from.
SYSTEM = "orders"


def many(c) -> F.Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


ROW_RULES_SQL = {
    "lineage_linkage": "NOT linked",
    "prediction_time_fields": "foreign_field OR late_field",
    "outcome_censoring": "(NOT (built AND monitored) AND outcome <> 'censored') OR (outcome = 'observed_negative' AND NOT window_complete) OR (outcome = 'censored' AND censor_reason IS NULL)",
    "split_followup": "outcome <> 'censored' AND NOT window_complete",
    "horizon_threshold_freeze": "horizon <> 'h14' OR threshold_version = ''",
    "single_system_boundary": "system <> 'orders'",
    "calibration_evidence": "(evidence = 'fit' AND split <> 'calibration_fit') OR (evidence = 'gate' AND split <> 'calibration_gate')",
    "provenance": "trim(source_system) = '' OR private_data OR predeclared_at >= score_time",
    "manifest_metadata": "trim(release_scope) = '' OR trim(coalesce(artifact, '')) = ''",
}
RULES_SQL = "rules AS (\n " + "\n UNION ALL ".join(f"SELECT row_id, '{n}' AS gate FROM corpus WHERE {c}" for n, c in ROW_RULES_SQL.items()) + """
 UNION ALL SELECT row_id, 'cluster_by_change' FROM corpus WHERE grp IN (SELECT grp FROM corpus GROUP BY grp HAVING count(DISTINCT split) > 1)
 UNION ALL SELECT row_id, 'adequacy' FROM corpus WHERE split IN (SELECT split FROM corpus GROUP BY split HAVING count(*) FILTER (WHERE outcome = 'observed_positive') < 50 OR count(*) FILTER (WHERE outcome = 'observed_negative') < 50))"""
NAMES = ["lineage_linkage", "prediction_time_fields", "outcome_censoring", "split_followup", "horizon_threshold_freeze", "cluster_by_change", "single_system_boundary", "calibration_evidence", "provenance", "manifest_metadata", "adequacy"]
NAMES_SQL = "names AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]) AS gate)"


def blank(text: F.Column) -> F.Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def misused(evidence: F.Column, split: F.Column) -> F.Column:
    """Rows that calibration was fitted or checked on outside the split kept for that; rows it did not use are fine."""
    return F.coalesce(((evidence == "fit") & (split != "calibration_fit")) | ((evidence == "gate") & (split != "calibration_gate")), F.lit(False))


def leaking(df: DataFrame, group: str = "grp") -> DataFrame:
    """Groups that span more than one split."""
    return df.groupBy(group).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select(group, F.lit(True).alias("leaks"))


def row_rules() -> dict[str, F.Column]:
    """What breaks each gate that a row can break by itself."""
    c = F.col
    seen = c("outcome") != "censored"
    return {
        "lineage_linkage": ~c("linked"),
        "prediction_time_fields": c("foreign_field") | c("late_field"),
        "outcome_censoring": (~(c("built") & c("monitored")) & seen) | ((c("outcome") == "observed_negative") & ~c("window_complete")) | (~seen & c("censor_reason").isNull()),
        "split_followup": seen & ~c("window_complete"),
        "horizon_threshold_freeze": (c("horizon") != "h14") | (c("threshold_version") == ""),
        "single_system_boundary": c("system") != SYSTEM,
        "calibration_evidence": misused(c("evidence"), c("split")),
        "provenance": blank(c("source_system")) | c("private_data") | (c("predeclared_at") >= c("score_time")),
        "manifest_metadata": blank(c("release_scope")) | blank(c("artifact")),
    }


def admission_failures(df: DataFrame) -> DataFrame:
    """(row_id, gate): row rules, the group rule and the adequacy of splits, from one pass over the corpus.

    Groups are many and are joined by key; splits are four."""
    per = df.groupBy("split").agg(many(F.col("outcome") == "observed_positive").alias("p"), many(F.col("outcome") == "observed_negative").alias("n"))
    few = per.select("split", ((F.col("p") < FLOOR) | (F.col("n") < FLOOR)).alias("few"))
    rows = df.join(leaking(df), "grp", "left").join(F.broadcast(few), "split", "left")
    rules = row_rules() | {"cluster_by_change": F.coalesce(F.col("leaks"), F.lit(False)), "adequacy": F.col("few")}
    return failed_rows(rows, "row_id", rules)


@query(f"WITH {CORPUS}, {RULES_SQL}, {NAMES_SQL} SELECT gate, count(row_id) = 0 AS passed, count(row_id) AS failed FROM names LEFT JOIN rules USING (gate) GROUP BY gate")
def g_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eleven admission gates over all rows."""
    return gate_report(admission_failures(corpus(spark, sf_dir)), NAMES)


@query(f"WITH {CORPUS}, {RULES_SQL} SELECT row_id, gate FROM rules")
def g_admit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows behind each failed gate, as a table."""
    return admission_failures(corpus(spark, sf_dir))


@query(f"WITH {CORPUS}, s AS (SELECT unnest(['train', 'calibration_fit', 'calibration_gate', 'test']) AS split) SELECT split, count(*) FILTER (WHERE outcome = 'observed_positive') AS observed_positive, count(*) FILTER (WHERE outcome = 'observed_negative') AS observed_negative, count(*) FILTER (WHERE outcome = 'censored') AS censored FROM s LEFT JOIN corpus USING (split) GROUP BY split")
def a_splitclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_grid(corpus(spark, sf_dir), list(SPLITS), CLASSES)


@query(f"""WITH {CORPUS} SELECT count(*) AS row_count, count(DISTINCT grp) AS groups, {', '.join(f"count(*) FILTER (WHERE outcome = '{c}') AS {c}" for c in CLASSES)}, count(*) FILTER (WHERE window_complete) AS complete, count(*) FILTER (WHERE NOT monitored) AS unmonitored, count(*) FILTER (WHERE NOT built) AS unbuilt, count(*) FILTER (WHERE late_field) AS late_fields, count(*) FILTER (WHERE foreign_field) AS foreign_fields, min(score_time) AS first_time, max(score_time) AS last_time FROM corpus""")
def a_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus counters, in one aggregation."""
    c = F.col
    return corpus(spark, sf_dir).agg(
        F.count("*").alias("row_count"), F.count_distinct("grp").alias("groups"), *(many(c("outcome") == x).alias(x) for x in CLASSES), many(c("window_complete")).alias("complete"), many(~c("monitored")).alias("unmonitored"), many(~c("built")).alias("unbuilt"),
        many(c("late_field")).alias("late_fields"), many(c("foreign_field")).alias("foreign_fields"), F.min("score_time").alias("first_time"), F.max("score_time").alias("last_time"),
    )


TERMINAL_SQL = """SELECT count(*) AS selected, count(*) FILTER (WHERE linked) AS terminal, count(*) FILTER (WHERE linked AND outcome <> 'censored') AS complete, count(*) FILTER (WHERE linked AND outcome = 'observed_positive') AS positive,
 count(*) FILTER (WHERE linked AND outcome = 'observed_negative') AS negative, count(*) FILTER (WHERE linked AND outcome = 'censored') AS censored, count(*) FILTER (WHERE foreign_field) AS withheld FROM corpus"""


def terminal_counts(df: DataFrame, by: list[str] = [], **more: F.Column) -> DataFrame:  # noqa: B006
    c = F.col
    return df.groupBy(*by).agg(
        F.count("*").alias("selected"), many(c("linked")).alias("terminal"), many(c("linked") & (c("outcome") != "censored")).alias("complete"), many(c("linked") & (c("outcome") == "observed_positive")).alias("positive"),
        many(c("linked") & (c("outcome") == "observed_negative")).alias("negative"), many(c("linked") & (c("outcome") == "censored")).alias("censored"), many(c("foreign_field")).alias("withheld"), *(v.alias(k) for k, v in more.items()),
    )


@query(f"WITH {CORPUS}, t AS ({TERMINAL_SQL}) SELECT *, terminal / nullif(selected, 0)::double AS coverage, complete / nullif(selected, 0)::double AS observation_rate, positive / nullif(complete, 0)::double AS positive_rate, negative / nullif(complete, 0)::double AS negative_rate, censored / nullif(selected, 0)::double AS censor_rate FROM t")
def a_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal counts and rates; a rate over nothing is null."""
    t = terminal_counts(corpus(spark, sf_dir))
    rate = lambda a, b: F.try_divide(a, b)
    return t.withColumns({"coverage": rate("terminal", "selected"), "observation_rate": rate("complete", "selected"), "positive_rate": rate("positive", "complete"), "negative_rate": rate("negative", "complete"), "censor_rate": rate("censored", "selected")})


@query("SELECT s_nationkey, avg((s_acctbal > 0)::int) AS rate, count(*) AS attempts, CASE WHEN count(*) < 2 THEN 'incomplete' WHEN bool_or(s_suppkey % 13 = 0) THEN 'clustered' WHEN avg((s_acctbal > 0)::int) < 0.9 THEN 'blocked' ELSE 'pass' END AS status FROM supplier GROUP BY 1")
def a_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build success per lane against a floor, with incomplete and clustered lanes apart."""
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.avg((F.col("s_acctbal") > 0).cast("int")).alias("rate"), F.count("*").alias("attempts"), F.bool_or(F.col("s_suppkey") % 13 == 0).alias("clustered"))
    status = F.when(F.col("attempts") < 2, "incomplete").when(F.col("clustered"), "clustered").when(F.col("rate") < 0.9, "blocked").otherwise("pass")
    return s.select("s_nationkey", "rate", "attempts", status.alias("status"))


@query("""WITH d AS (SELECT o_custkey % 40 AS lane, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY r) - 1 AS pos, r, count(*) OVER (PARTITION BY o_custkey % 40) AS n FROM (SELECT o_custkey, round(avg((o_orderstatus <> 'P')::int), 9) AS r FROM orders GROUP BY 1))
 SELECT lane, least(0.9, floor(r * 100) / 100)::double AS floor FROM d WHERE pos = floor(0.05 * (n - 1))""")
def a_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifth-percentile floor by index, cut to two places, 0.90 at most."""
    rates = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.avg((F.col("o_orderstatus") != "P").cast("int")), 9).alias("r"))
    at = at_ranks(rates.select((F.col("o_custkey") % 40).alias("lane"), "r"), ["lane"], "r", {"low": F.floor(0.05 * (F.col("n") - 1))})
    return at.select("lane", F.least(F.lit(0.9), F.floor(F.col("low") * 100) / 100).alias("floor"))


SCREEN_SQL = "CASE WHEN s_suppkey % 11 = 0 THEN 'not public' WHEN s_acctbal < 0 THEN 'no supply' WHEN s_acctbal * (0.1 + (s_suppkey % 9) / 10.0) < 800 THEN 'supply below floor' WHEN s_suppkey % 7 = 0 THEN 'build unstable' ELSE 'accepted' END"


@query(f"SELECT s_suppkey, round(s_acctbal * (0.1 + (s_suppkey % 9) / 10.0), 4)::double AS projected, {SCREEN_SQL} AS screen FROM supplier")
def a_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates screened in order; the first screen that stops one."""
    k = F.col("s_suppkey")
    projected = F.col("s_acctbal") * (0.1 + (k % 9) / 10.0)
    screen = F.coalesce(F.when(k % 11 == 0, "not public"), F.when(F.col("s_acctbal") < 0, "no supply"), F.when(projected < 800, "supply below floor"), F.when(k % 7 == 0, "build unstable"), F.lit("accepted"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(projected, 4).alias("projected"), screen.alias("screen"))


@query(f"WITH c AS (SELECT *, {SCREEN_SQL} AS screen FROM supplier) SELECT screen, count(*) AS candidates, round(sum(s_acctbal), 2) AS supply FROM c GROUP BY 1")
def g_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a_supply(spark, sf_dir).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey")
    return rows.groupBy("screen").agg(F.count("*").alias("candidates"), F.round(F.sum("s_acctbal"), 2).alias("supply"))


REASON_SQL = "CASE WHEN NOT linked THEN 'capture lineage is incomplete' WHEN horizon <> 'h14' OR threshold_version = '' THEN 'capture does not match the profile' WHEN outcome = 'censored' AND censor_reason IS NULL THEN 'censored capture lacks reason' WHEN foreign_field THEN 'prediction fields violate the profile' WHEN late_field THEN 'prediction field is late' WHEN outcome <> 'censored' AND NOT window_complete THEN 'follow-up exceeds split' END"


def assembled(df: DataFrame, key: str) -> DataFrame:
    """Adds reason (null if accepted): the row's first failing check, else that an accepted row with the same key comes
    before it in the order of content identity. A hot key is one map-side combined minimum, not a sorted window."""
    c = F.col
    reason = first_reason(
        (~c("linked"), "capture lineage is incomplete"), ((c("horizon") != "h14") | (c("threshold_version") == ""), "capture does not match the profile"),
        ((c("outcome") == "censored") & c("censor_reason").isNull(), "censored capture lacks reason"), (c("foreign_field"), "prediction fields violate the profile"),
        (c("late_field"), "prediction field is late"), ((c("outcome") != "censored") & ~c("window_complete"), "follow-up exceeds split"),
    )
    rows = df.withColumn("reason", reason).withColumn("identity", F.md5(c("row_id").cast("string")))
    first = rows.where("reason IS NULL").groupBy(key).agg(F.min("identity").alias("first"))
    rows = rows.join(first, key, "left")
    return rows.withColumn("reason", F.coalesce("reason", F.when(c("identity") != c("first"), "duplicate change"))).drop("first", "identity")


ASSEMBLED_SQL = f"a AS (SELECT *, {REASON_SQL} AS r0, md5(row_id::varchar) AS identity FROM corpus), b AS (SELECT *, coalesce(r0, CASE WHEN identity <> min(identity) FILTER (WHERE r0 IS NULL) OVER (PARTITION BY grp) THEN 'duplicate change' END) AS reason FROM a)"


@query(f"WITH {CORPUS}, {ASSEMBLED_SQL} SELECT row_id, split, reason FROM b")
def g_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures to corpus rows or rejections: the first failing reason, and the first accepted row of a change wins."""
    return assembled(corpus(spark, sf_dir), "grp").select("row_id", "split", "reason")


@query(f"WITH {CORPUS}, {ASSEMBLED_SQL} SELECT grp, count(*) FILTER (WHERE reason IS NULL) AS accepted, count(*) FILTER (WHERE reason = 'duplicate change') AS repeats FROM b GROUP BY grp")
def w_firstwin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assembled(corpus(spark, sf_dir), "grp")
    return rows.groupBy("grp").agg(many(F.col("reason").isNull()).alias("accepted"), many(F.col("reason") == "duplicate change").alias("repeats"))


@query(f"WITH {CORPUS} SELECT row_id, grp FROM corpus WHERE grp IN (SELECT grp FROM corpus GROUP BY grp HAVING count(DISTINCT split) > 1)")
def w_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of groups that span splits."""
    c = corpus(spark, sf_dir)
    return c.join(leaking(c).select("grp"), "grp", "left_semi").select("row_id", "grp")


@query(f"WITH {CORPUS}, {ASSEMBLED_SQL} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM b GROUP BY 1")
def snk_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows and the ledger of rejections, written side by side from one pass and counted on reading back."""
    from ..sources.sinks import read_ledger, write_ledger

    path = write_ledger(assembled(corpus(spark, sf_dir), "grp").select("row_id", "split", "outcome", "reason"))
    accepted, rejected = read_ledger(spark, path)
    both = accepted.select(F.lit("accepted").alias("reason")).unionAll(rejected.select("reason"))
    return both.groupBy("reason").agg(F.count("*").alias("n"))


PUBLIC_SQL = "CASE WHEN NOT starts_with(url, 'https://') OR contains(url, '@') OR contains(url, '?token=') THEN 'reference is not public' WHEN page_id % 7 = 0 THEN 'artifact missing' WHEN strlen(html) < 2000 THEN 'window incomplete' END"


@query(f"SELECT page_id, {PUBLIC_SQL} IS NULL AS included, coalesce({PUBLIC_SQL}, 'included') AS class FROM pages")
def g_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public corpus: include a snapshot or withhold it with its class."""
    u = F.col("url")
    reason = first_reason((~u.startswith("https://") | u.contains("@") | u.contains("?token="), "reference is not public"), (F.col("page_id") % 7 == 0, "artifact missing"), (F.octet_length("html") < 2000, "window incomplete"))
    return table(spark, sf_dir, "pages").select("page_id", reason.isNull().alias("included"), F.coalesce(reason, F.lit("included")).alias("class"))


@query(f"SELECT page_id, CASE WHEN {PUBLIC_SQL} IS NOT NULL THEN 'censored' WHEN page_id % 2 = 0 THEN 'observed_positive' ELSE 'observed_negative' END AS outcome, {PUBLIC_SQL} AS censor_reason FROM pages")
def g_observe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public observations normalised; what is invalid is censored, never negative."""
    rows = g_materialize(spark, sf_dir)
    outcome = F.when(~F.col("included"), "censored").when(F.col("page_id") % 2 == 0, "observed_positive").otherwise("observed_negative")
    return rows.select("page_id", outcome.alias("outcome"), F.when(~F.col("included"), F.col("class")).alias("censor_reason"))


CI_SQL = """
WITH s AS (SELECT page_id AS id, 'sys' || (page_id // 2 % 7) AS system, CASE WHEN page_id % 11 = 0 THEN substr(sha1('r' || page_id // 2), 2) ELSE sha1('r' || page_id // 2) END AS revision,
   CASE WHEN page_id % 13 = 0 THEN 'http://x/' WHEN page_id % 13 = 1 THEN 'https://x/?token=1' ELSE 'https://x/' END || page_id // 2 AS source, page_id % 17 = 0 AS private, CASE WHEN page_id % 19 = 0 THEN 'yesterday' ELSE '2024-01-02T03:04:05Z' END AS observed,
   CASE WHEN page_id % 5 <> 0 THEN 'https://ci/' || page_id END AS ci, CASE WHEN page_id % 7 = 0 THEN 'other' ELSE sha1('r' || page_id // 2) END AS ci_revision FROM pages),
 v AS (SELECT *, CASE WHEN length(revision) <> 40 THEN 'no immutable revision' WHEN NOT starts_with(source, 'https://') OR contains(source, '@') OR contains(source, '?token=') THEN 'source reference is not public and safe' WHEN private THEN 'private evidence'
   WHEN observed = 'yesterday' THEN 'observed timestamp is invalid' WHEN ci IS NOT NULL AND ci_revision <> revision THEN 'CI evidence is of another revision' END AS reason FROM s),
 f AS (SELECT system, revision, min(id) AS first FROM v WHERE reason IS NULL GROUP BY ALL),
 r AS (SELECT v.* EXCLUDE (reason), coalesce(reason, CASE WHEN id <> first THEN 'revision is there already' END) AS reason FROM v LEFT JOIN f USING (system, revision))
SELECT id, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN ci IS NULL THEN 'unavailable' ELSE 'available' END AS status, coalesce(reason, CASE WHEN ci IS NULL THEN 'public CI evidence is unavailable' END) AS reason,
  CASE WHEN reason IS NULL THEN sha256('{"available":' || (ci IS NOT NULL) || ',"ci_reference":' || coalesce('"' || ci || '"', 'null') || ',"observed_at":"' || observed || '","revision":"' || revision || '","source_reference":"' || source || '","system_id":"' || system || '","unavailable_reason":' || CASE WHEN ci IS NULL THEN '"public CI evidence is unavailable"' ELSE 'null' END || '}') END AS identity FROM r"""


def public_evidence(snapshots: DataFrame) -> DataFrame:
    """snapshots (id, system_id, revision, source_reference, ci_reference, ci_revision, observed_at, private) -> (id, status,
    reason, identity). Of valid snapshots of one system and revision the first by id counts; its minimum is combined
    where the rows are read, so a revision may have any number of them."""
    c = F.col
    public = lambda x: F.coalesce(x.startswith("https://") & ~F.contains(x, F.lit("@")) & ~F.contains(x, F.lit("?token=")), F.lit(False))
    keyed = F.coalesce((F.trim("system_id") != "") & (F.char_length("revision") == 40), F.lit(False))
    dated = F.try_to_timestamp(F.regexp_replace("observed_at", "Z$", "+00:00")).isNotNull()
    matching = c("ci_reference").isNull() | (public(c("ci_reference")) & F.coalesce(c("ci_revision") == c("revision"), F.lit(False)))
    checked = snapshots.withColumn("_bad", first_reason((~keyed, "no immutable revision"), (~public(c("source_reference")), "source reference is not public and safe"), (c("private"), "private evidence"), (~dated, "observed timestamp is invalid"), (~matching, "CI evidence is of another revision")))
    first = checked.where("_bad IS NULL").groupBy("system_id", "revision").agg(F.min("id").alias("_first"))
    rows = checked.join(first, ["system_id", "revision"], "left")
    bad = F.coalesce("_bad", F.when(c("id") != c("_first"), "revision is there already"))
    there = c("ci_reference").isNotNull()
    unavailable = F.when(~there, "public CI evidence is unavailable")
    record = F.struct("system_id", "revision", "source_reference", "ci_reference", "observed_at", there.alias("available"), unavailable.alias("unavailable_reason"))
    out = rows.select("id", bad.alias("_bad"), there.alias("_there"), unavailable.alias("_why"), record.alias("_record"))
    said = F.when(c("_bad").isNull(), identity(c("_record"), out.schema["_record"].dataType))
    return out.select("id", F.when(c("_bad").isNotNull(), "rejected").when(c("_there"), "available").otherwise("unavailable").alias("status"), F.coalesce("_bad", "_why").alias("reason"), said.alias("identity"))


@query(CI_SQL)
def g_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public version control and CI evidence of each snapshot: available, unavailable, or why it is rejected."""
    i = F.col("page_id")
    half = F.floor(i / 2)
    revision = F.sha1(F.concat(F.lit("r"), half.cast("string")))
    source = F.concat(F.when(i % 13 == 0, "http://x/").when(i % 13 == 1, "https://x/?token=1").otherwise("https://x/"), half.cast("string"))
    snapshots = table(spark, sf_dir, "pages").select(
        i.alias("id"), F.concat(F.lit("sys"), (half % 7).cast("string")).alias("system_id"), F.when(i % 11 == 0, F.substring(revision, 2, 40)).otherwise(revision).alias("revision"), source.alias("source_reference"),
        F.when(i % 5 != 0, F.concat(F.lit("https://ci/"), i.cast("string"))).alias("ci_reference"), F.when(i % 7 == 0, "other").otherwise(revision).alias("ci_revision"),
        F.when(i % 19 == 0, "yesterday").otherwise("2024-01-02T03:04:05Z").alias("observed_at"), (i % 17 == 0).alias("private"),
    )
    return public_evidence(snapshots)


@query(f"WITH {CORPUS}, s AS (SELECT split, count(*) FILTER (WHERE outcome = 'observed_positive') AS p, count(*) FILTER (WHERE outcome = 'observed_negative') AS n, count(*) FILTER (WHERE outcome = 'censored') AS c FROM corpus GROUP BY split) SELECT split, p AS observed_positive, n AS observed_negative, c AS censored, p + n + c AS total, (SELECT count(*) FROM corpus) AS corpus_total, p + n + c > 0 AS complete FROM s")
def g_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus manifest: the grid of counts with totals."""
    grid = counts_grid(corpus(spark, sf_dir), list(SPLITS), CLASSES).withColumn("total", sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0])))
    every = grid.agg(F.sum("total").alias("corpus_total"))
    return grid.crossJoin(F.broadcast(every)).withColumn("complete", F.col("total") > 0)


MANIFEST_SQL = """WITH m AS (SELECT s_suppkey AS k, s_suppkey % 12 AS f FROM supplier)
 SELECT k AS supplier, CASE f WHEN 1 THEN 'missing fields: horizon_rule, source_system' WHEN 2 THEN 'missing fields: thresholds_frozen' WHEN 3 THEN 'source_system is required' WHEN 4 THEN 'release_scope is required'
  WHEN 5 THEN 'horizon_rule is required' WHEN 6 THEN 'counts must have the canonical splits' WHEN 7 THEN 'counts must have the canonical splits' WHEN 8 THEN 'missing count for calibration_gate:censored' END AS error FROM m"""


@query(MANIFEST_SQL)
def g_manifest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of G-MANIFEST: manifests with missing and blank fields, other splits and missing counts."""
    f = F.col("s_suppkey") % 12
    counts = lambda split: F.map_from_entries(F.array(*(F.struct(F.lit(c), F.lit(1)) for c in CLASSES if (split, c) != ("calibration_gate", "censored")), *[F.struct(F.when(f == 8, "other").otherwise("censored"), F.lit(1))] * (split == "calibration_gate")))
    names = {x: F.when((f == 6) & (F.lit(x) == "test"), "holdout").otherwise(x) for x in SPLITS}
    whole = F.map_from_entries(F.array(*(F.struct(n, counts(x)) for x, n in names.items())))
    part = F.map_filter(whole, lambda k, _: (f != 7) | (k != "train"))
    m = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("supplier"), F.when(f == 3, " ").when(f != 1, F.col("s_name")).alias("source_system"), F.when(f == 4, "").otherwise("public").alias("release_scope"),
        F.when(f == 5, "  ").when(f != 1, "h14").alias("horizon_rule"), F.when(f != 2, True).alias("thresholds_frozen"), F.array(*map(F.lit, SPLITS)).alias("split_definitions"), part.alias("counts_by_split"),
    )
    return m.select("supplier", manifest_error(list(SPLITS), CLASSES).alias("error"))


@query(f"WITH {CORPUS}, {LANES} SELECT row_id, CASE WHEN NOT linked THEN 'missing' WHEN row_id % 101 = 0 THEN 'conflict' WHEN differing <> '' THEN 'lane mismatch' ELSE outcome END AS record, CASE WHEN linked THEN differing ELSE '' END AS differing FROM lanes")
def g_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One terminal record for each selected revision, from its capture and the frozen lane; some were captured twice."""
    captures = lanes(spark, sf_dir).where("linked")
    twice = captures.unionAll(captures.where("row_id % 101 = 0"))
    selected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    return terminal_records(selected, twice, "row_id", PROFILE)


@query(f"WITH {CORPUS} SELECT split, bool_and(built) AS build, bool_and(linked) AS deployment, bool_and(monitored) AS monitoring, bool_and(window_complete) AS followup, CASE WHEN bool_and(built AND linked AND monitored AND window_complete) THEN 'available' WHEN bool_and(built) OR bool_and(linked) THEN 'partial' ELSE 'withheld' END AS status FROM corpus GROUP BY split")
def g_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence categories that all captures of a split share."""
    e = corpus(spark, sf_dir).groupBy("split").agg(F.bool_and("built").alias("build"), F.bool_and("linked").alias("deployment"), F.bool_and("monitored").alias("monitoring"), F.bool_and("window_complete").alias("followup"))
    c = F.col
    return e.withColumn("status", F.when(c("build") & c("deployment") & c("monitoring") & c("followup"), "available").when(c("build") | c("deployment"), "partial").otherwise("withheld"))


DIGEST_SQL = "SELECT family, count(*) AS n, bit_xor(('0x' || substr(md5(unit || ':' || {0}), 1, 8))::bigint) AS digest FROM scored GROUP BY family"


@query(f"WITH {SCORED}, d AS ({DIGEST_SQL.format('y')}), stored AS ({DIGEST_SQL.format("CASE WHEN family = 'O' AND unit % 1000 = 1 THEN 1 - y ELSE y END")}) SELECT family, d.n, d.digest, d.digest = stored.digest AND d.n = stored.n AS matches FROM d LEFT JOIN stored USING (family)")
def g_poolauth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooling is bound to the samples: each family's order-free digest must be the one that was stored when the policy
    was signed. Some outcomes of one family have changed since then, so it may not be pooled."""
    rows = scored(spark, sf_dir)
    changed = (F.col("family") == "O") & (F.col("unit") % 1000 == 1)
    path = scratch(spark, "policy")
    sample_digests(rows.withColumn("y", F.when(changed, 1 - F.col("y")).otherwise(F.col("y")))).write.parquet(path)
    stored = spark.read.parquet(path).select("family", F.col("n").alias("_n"), F.col("digest").alias("_digest"))
    same = (F.col("digest") == F.col("_digest")) & (F.col("n") == F.col("_n"))
    return sample_digests(rows).join(stored, "family", "left").select("family", "n", "digest", same.alias("matches"))


def sample_digests(df: DataFrame) -> DataFrame:
    """(family, n, digest): the size of each family's sample and a digest that doesn't depend on the order of rows."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("unit").cast("string"), F.col("y").cast("string"))), 1, 8), 16, 10).cast("long")
    return df.groupBy("family").agg(F.count("*").alias("n"), F.bit_xor(h).alias("digest"))


def sample_evidence(df: DataFrame) -> DataFrame:
    """df (family, unit, s, y) -> (family, n, sample): the size of each family's sample and a digest of all its rows that
    doesn't depend on their order: two sums of 28 bits of each row's hash, so that repeated rows count."""
    h = F.md5(F.concat_ws(":", F.col("unit").cast("string"), F.col("y").cast("string"), F.round(F.col("s") * 1e6).cast("long").cast("string")))
    part = lambda at: F.sum(F.conv(F.substring(h, at, 7), 16, 10).cast("long")).cast("string")
    return df.groupBy("family").agg(F.count("*").alias("n"), F.concat_ws("-", part(1), part(8)).alias("sample"))


def pool_authorization(df: DataFrame, now: DataFrame, stored: DataFrame) -> DataFrame:
    """df (family, unit, s, y); now (family, definition); stored evidence (family, n, sample, definition, policy) -> a row a
    pair of families (first, second, authorized, reason, n, pooled_ece).

    A pair is authorised if both families have evidence for their present definition, the two definitions and policies
    are the same, and both samples are those that the evidence was taken from. Only then are the families' bins added up
    to a pooled calibration error. Pairs are of families, which are few."""
    c = F.col
    own = sample_evidence(df).join(now, "family").join(stored.select("family", c("n").alias("_n"), c("sample").alias("_sample"), c("definition").alias("_definition"), "policy"), "family", "left")
    evident = F.coalesce(c("definition") == c("_definition"), F.lit(False))
    s = own.select("family", "n", "definition", "policy", evident.alias("evident"), F.coalesce((c("n") == c("_n")) & (c("sample") == c("_sample")), F.lit(False)).alias("same"))
    a, b = (s.select(*(c(x).alias(f"{p}_{x}") for x in s.columns)) for p in ("a", "b"))
    reason = first_reason(
        (c("a_definition") != c("b_definition"), "definitions differ"), (~c("a_evident"), "first evidence is of another definition"), (~c("b_evident"), "second evidence is of another definition"),
        (c("a_policy") != c("b_policy"), "policies differ"), (~c("a_same"), "first sample does not match"), (~c("b_same"), "second sample does not match"),
    )
    pairs = a.join(F.broadcast(b), c("a_family") < c("b_family")).select(c("a_family").alias("first"), c("b_family").alias("second"), (c("a_n") + c("b_n")).alias("n"), reason.alias("reason"))
    bins = reliability(df, ["family"]).select("family", "bin", c("n").alias("w"), (c("n") * (c("mean_score") - c("frequency"))).alias("gap"))
    of = pairs.where("reason IS NULL").select("first", "second", F.explode(F.array("first", "second")).alias("family")).join(bins, "family")
    pooled = of.groupBy("first", "second", "bin").agg(F.sum("gap").alias("gap"), F.sum("w").alias("w")).groupBy("first", "second").agg((F.sum(F.abs("gap")) / F.sum("w")).alias("pooled_ece"))
    return pairs.join(pooled, ["first", "second"], "left").select("first", "second", c("reason").isNull().alias("authorized"), F.coalesce("reason", F.lit("")).alias("reason"), "n", "pooled_ece")


LANE_SAMPLES = """SELECT family, count(*) AS n, sum(('0x' || substr(h, 1, 7))::bigint)::varchar || '-' || sum(('0x' || substr(h, 8, 7))::bigint)::varchar AS sample
 FROM (SELECT family, md5(unit || ':' || {0} || ':' || round(s * 1e6)::bigint) AS h FROM lanes) GROUP BY family"""


@query(f"""WITH {SCORED}, lanes AS (SELECT family || (unit % 6) AS family, unit, s, y FROM scored), now AS ({LANE_SAMPLES.format("y")}),
 stored AS ({LANE_SAMPLES.format("CASE WHEN family = 'O3' AND unit % 100 = 3 THEN 1 - y ELSE y END")}),
 e AS (SELECT n.family, n.n, CASE WHEN right(n.family, 1) = '1' THEN '14 day' ELSE '7 day' END AS definition, CASE WHEN right(n.family, 1) IN ('2', '1') THEN '14 day' ELSE '7 day' END AS evident, CASE WHEN right(n.family, 1) = '4' THEN 'most 0.1' ELSE 'most 0.05' END AS policy, n.n = s.n AND n.sample = s.sample AS same FROM now n JOIN stored s USING (family)),
 p AS (SELECT a.family AS first, b.family AS second, a.n + b.n AS n, CASE WHEN a.definition <> b.definition THEN 'definitions differ' WHEN a.evident <> a.definition THEN 'first evidence is of another definition' WHEN b.evident <> b.definition THEN 'second evidence is of another definition'
  WHEN a.policy <> b.policy THEN 'policies differ' WHEN NOT a.same THEN 'first sample does not match' WHEN NOT b.same THEN 'second sample does not match' ELSE '' END AS reason FROM e a JOIN e b ON a.family < b.family),
 bins AS (SELECT family, {BIN_SQL} AS bin, count(*) AS w, sum(s) - sum(y) AS gap FROM lanes GROUP BY ALL),
 pool AS (SELECT first, second, sum(abs(gap)) / sum(w) AS ece FROM (SELECT first, second, bin, sum(gap) AS gap, sum(w) AS w FROM p JOIN bins ON family IN (first, second) WHERE reason = '' GROUP BY ALL) GROUP BY ALL)
 SELECT first, second, reason = '' AS authorized, reason, n, round(ece, 6) AS pooled_ece FROM p LEFT JOIN pool USING (first, second)""")
def g_poolpairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooling of lanes by stored evidence, the second half of G-POOLAUTH. One lane's definition has changed since, one
    lane's outcomes have, one has another policy, and two have another definition than the rest."""
    lane = F.concat("family", (F.col("unit") % 6).cast("string"))
    rows = scored(spark, sf_dir).select(lane.alias("family"), "unit", "s", "y")
    last = F.substring("family", -1, 1)
    changed = (F.col("family") == "O3") & (F.col("unit") % 100 == 3)
    evidence = sample_evidence(rows.withColumn("y", F.when(changed, 1 - F.col("y")).otherwise(F.col("y"))))
    path = scratch(spark, "evidence")
    evidence.select("*", F.when(last.isin("1", "2"), "14 day").otherwise("7 day").alias("definition"), F.when(last == "4", "most 0.1").otherwise("most 0.05").alias("policy")).write.parquet(path)
    now = rows.select("family").distinct().select("family", F.when(last == "1", "14 day").otherwise("7 day").alias("definition"))
    out = pool_authorization(rows, now, spark.read.parquet(path))
    return out.withColumn("pooled_ece", F.round("pooled_ece", 6))


REPORT_VIOLATIONS = {
    "counts do not add up": "p + q <> n", "metric out of domain": "metric > 1", "below floor": "n < 3", "terminal count exceeds selected": "n > selected",
    "classes do not add up": "p + q + z <> n", "raw scores published": "contains(fields, 'operational_score')",
}
IDENTITY_SQL = """sha256('{"n":' || n || ',"p":' || p || ',"q":' || q || ',"selected":' || selected || '}')"""


def report_identity() -> F.Column:
    """SHA-256 of a report's counts as canonical JSON."""
    part = lambda x: [F.lit(f'"{x}":'), F.col(x).cast("string")]
    return F.sha2(F.concat(F.lit("{"), *part("n"), F.lit(","), *part("p"), F.lit(","), *part("q"), F.lit(","), *part("selected"), F.lit("}")), 256)


def recheck_reports(reports: DataFrame, key: str) -> DataFrame:
    """Stored reports (n, p, q, z, selected, metric, fields, identity) -> (key, violation), a row a violation."""
    rules = {name: F.expr(bad) for name, bad in REPORT_VIOLATIONS.items()}
    return failed_rows(reports, key, rules | {"identity does not match": F.col("identity") != report_identity()}).withColumnRenamed("gate", "violation")


@query(f"""WITH o AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS p, count(*) FILTER (WHERE o_orderstatus = 'O') AS q, count(*) FILTER (WHERE o_orderstatus = 'P') AS z, avg(o_totalprice / 400000) AS metric,
  count(*) + CASE WHEN o_custkey % 29 = 3 THEN -1 ELSE o_custkey % 4 END AS selected, CASE WHEN o_custkey % 31 = 4 THEN 'counts operational_score' ELSE 'counts' END AS fields FROM orders GROUP BY o_custkey),
 i AS (SELECT *, {IDENTITY_SQL} AS identity FROM o), r AS (SELECT * REPLACE (CASE WHEN o_custkey % 23 = 5 THEN p + 1 ELSE p END AS p) FROM i)
 SELECT o_custkey, unnest([x for x in [{", ".join(f"CASE WHEN {bad} THEN '{name}' END" for name, bad in REPORT_VIOLATIONS.items())}, CASE WHEN identity <> {IDENTITY_SQL} THEN 'identity does not match' END] if x IS NOT NULL]) AS violation FROM r""")
def g_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored reports re-checked: counts, domains, floors, what they publish, and their identity; a row a violation. Some
    reports were altered after their identity was taken."""
    k = F.col("o_custkey")
    is_ = lambda s: many(F.col("o_orderstatus") == s)
    r = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), is_("F").alias("p"), is_("O").alias("q"), is_("P").alias("z"), F.avg(F.col("o_totalprice") / 400000).alias("metric"))
    r = r.withColumn("selected", F.col("n") + F.when(k % 29 == 3, -1).otherwise(k % 4)).withColumn("fields", F.when(k % 31 == 4, "counts operational_score").otherwise("counts")).withColumn("identity", report_identity())
    path = scratch(spark, "reports")
    r.withColumn("p", F.col("p") + F.when(k % 23 == 5, 1).otherwise(0)).write.parquet(path)
    return recheck_reports(spark.read.parquet(path), "o_custkey")


OPERATIONS = ["compare", "rank", "pool", "transfer", "average", "combine"]
FLAGS = ["same_target", "metric_compatible", "samples_aligned", "mapping_declared", "mixture_declared", "weights_declared", "population_same", "transport_validated", "calibrated", "time_aligned", "heldout", "independent", "dependence_model"]
CASES = "cases AS (SELECT o_orderkey AS id, ['compare', 'rank', 'pool', 'transfer', 'average', 'combine'][o_orderkey % 6 + 1] AS op, " + ", ".join(f"(o_orderkey // {k + 2}) % {k % 3 + 2} <> 0 AS {f}" for k, f in enumerate(FLAGS)) + " FROM orders)"
EXACT_SQL = """CASE op WHEN 'compare' THEN metric_compatible AND samples_aligned AND same_target WHEN 'rank' THEN (same_target AND samples_aligned) OR (mapping_declared AND metric_compatible)
 WHEN 'pool' THEN (same_target OR mixture_declared) AND weights_declared AND samples_aligned WHEN 'transfer' THEN calibrated AND ((same_target AND population_same) OR (transport_validated AND NOT population_same))
 WHEN 'average' THEN same_target AND time_aligned AND heldout ELSE same_target AND (independent OR dependence_model) END"""
LOOSE_SQL = """CASE op WHEN 'compare' THEN same_target AND metric_compatible WHEN 'rank' THEN (same_target AND metric_compatible) OR mapping_declared WHEN 'pool' THEN (same_target OR mixture_declared) AND weights_declared
 WHEN 'transfer' THEN (same_target AND population_same) OR transport_validated ELSE same_target END"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to combine scores, with what is declared about them."""
    k = F.col("o_orderkey")
    op = F.element_at(F.array(*map(F.lit, OPERATIONS)), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), op.alias("op"), *((F.floor(k / (i + 2)) % (i % 3 + 2) != 0).alias(f) for i, f in enumerate(FLAGS)))


def permits_exact() -> F.Column:
    """What each operation needs, of itself."""
    c = {f: F.col(f) for f in FLAGS}
    same, op = c["same_target"], F.col("op")
    moved = (same & c["population_same"]) | (c["transport_validated"] & ~c["population_same"])
    return (
        F.when(op == "compare", c["metric_compatible"] & c["samples_aligned"] & same).when(op == "rank", (same & c["samples_aligned"]) | (c["mapping_declared"] & c["metric_compatible"]))
        .when(op == "pool", (same | c["mixture_declared"]) & c["weights_declared"] & c["samples_aligned"]).when(op == "transfer", c["calibrated"] & moved)
        .when(op == "average", same & c["time_aligned"] & c["heldout"]).otherwise(same & (c["independent"] | c["dependence_model"]))
    )


def permits_metadata() -> F.Column:
    """What declared metadata alone would allow."""
    c = {f: F.col(f) for f in FLAGS}
    same, op = c["same_target"], F.col("op")
    return (
        F.when(op == "compare", same & c["metric_compatible"]).when(op == "rank", (same & c["metric_compatible"]) | c["mapping_declared"])
        .when(op == "pool", (same | c["mixture_declared"]) & c["weights_declared"]).when(op == "transfer", (same & c["population_same"]) | c["transport_validated"]).otherwise(same)
    )


@query(f"WITH {CASES} SELECT id, op, {EXACT_SQL} AS permitted FROM cases")
def fn_opgate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("id", "op", permits_exact().alias("permitted"))


def relationship() -> F.Column:
    """What the scores of a request have to do with each other, as its operation sees it."""
    c, op = F.col, F.col("op")
    return (
        F.when(c("mixture_declared") & (op == "pool"), "declared mixture").when(c("mapping_declared") & (op == "rank"), "decision objective")
        .when(c("transport_validated") & (op == "transfer"), "validated transport").when(c("same_target"), "same target").otherwise("different targets")
    )


RELATION_SQL = """CASE WHEN mixture_declared AND op = 'pool' THEN 'declared mixture' WHEN mapping_declared AND op = 'rank' THEN 'decision objective'
 WHEN transport_validated AND op = 'transfer' THEN 'validated transport' WHEN same_target THEN 'same target' ELSE 'different targets' END"""


def selection_changes(scores: DataFrame, fraction: float = 0.2) -> DataFrame:
    """scores (fixture, target, s) -> (fixture, changed): how many rows are selected either by the top of all or by the
    top of each target, but not by both. The top is max(1, ceil(fraction n)) rows and those that tie with the last.

    Ranks are running sums over counts by score, so no fixture is sorted by one task."""
    k, before = F.col("k"), F.col("k_before")
    per = scores.groupBy("fixture", "target", "s").agg(F.count("*").alias("k"))
    want = lambda by: per.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.sum("k") * fraction)).alias("want"))
    ranked = lambda rows, by: running(rows, by, "s", ["k"], ascending=False).join(want(by), by)
    local = ranked(per, ["fixture", "target"]).select("fixture", "s", "k", (before < F.col("want")).alias("locally"))
    every = ranked(per.groupBy("fixture", "s").agg(F.sum("k").alias("k")), ["fixture"]).select("fixture", "s", (before < F.col("want")).alias("globally"))
    return local.join(every, ["fixture", "s"]).groupBy("fixture").agg(F.sum(F.when(F.col("locally") != F.col("globally"), k).otherwise(0)).alias("changed"))


def rule_comparison(requests: DataFrame, changes: DataFrame) -> DataFrame:
    """requests: op, the flags as declared, and what is true of each: valid, expected (relationship), fixture (rank only).

    A row a permission rule: what it permits wrongly and refuses needlessly, relationships that it misreads, and how many
    selections change because it ranks all rows where each target should be ranked, or the other way round."""
    c = F.col
    same = F.when(c("same_target"), "same target").otherwise("different targets")
    rules = {"naive": (F.lit(True), F.lit("same target")), "label": (c("same_target"), same), "metadata": (permits_metadata(), relationship()), "exact": (permits_exact(), relationship())}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), p.alias("allowed"), r.alias("relation")) for n, (p, r) in rules.items())))
    rows = requests.join(changes, "fixture", "left").select("valid", "expected", "changed", each.alias("x")).select("x.rule", "x.allowed", "x.relation", "valid", "expected", "changed")
    wrong = c("allowed") != c("valid")
    per = rows.groupBy("rule").agg(
        F.count("*").alias("requests"), many(c("allowed") & ~c("valid")).alias("false_permissions"), many(~c("valid")).alias("invalid_requests"), many(~c("allowed") & c("valid")).alias("false_refusals"), many(c("valid")).alias("valid_requests"),
        many(c("relation") != c("expected")).alias("interpretation_errors"), many(c("changed").isNotNull()).alias("rankings"), many(wrong & (c("changed") > 0)).alias("rankings_changed"), F.coalesce(F.sum(F.when(wrong, c("changed"))), F.lit(0)).alias("selections_changed"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(c(a), c(b)), F.lit(0.0))
    return per.withColumn("false_permission_rate", rate("false_permissions", "invalid_requests")).withColumn("false_refusal_rate", rate("false_refusals", "valid_requests"))


@query(f"""WITH {CASES}, t AS (SELECT *, {EXACT_SQL} AS valid, {RELATION_SQL} AS expected, CASE WHEN op = 'rank' THEN (id // 6) % 25 END AS fixture FROM cases),
 d AS (SELECT * REPLACE (same_target <> (id % 17 = 0) AS same_target) FROM t),
 k AS (SELECT s_nationkey AS fixture, s_suppkey % 2 AS target, s_acctbal / 10000 AS s FROM supplier),
 r AS (SELECT fixture, rank() OVER (PARTITION BY fixture ORDER BY s DESC) - 1 < greatest(1, ceil(0.2 * count(*) OVER (PARTITION BY fixture))) AS g, rank() OVER (PARTITION BY fixture, target ORDER BY s DESC) - 1 < greatest(1, ceil(0.2 * count(*) OVER (PARTITION BY fixture, target))) AS l FROM k),
 ch AS (SELECT fixture, count(*) FILTER (WHERE g <> l) AS changed FROM r GROUP BY fixture),
 p AS (SELECT valid, expected, changed, unnest(['naive', 'label', 'metadata', 'exact']) AS rule, unnest([true, same_target, {LOOSE_SQL}, {EXACT_SQL}]) AS allowed,
  unnest(['same target', CASE WHEN same_target THEN 'same target' ELSE 'different targets' END, {RELATION_SQL}, {RELATION_SQL}]) AS relation FROM d LEFT JOIN ch USING (fixture)),
 a AS (SELECT rule, count(*) AS requests, count(*) FILTER (WHERE allowed AND NOT valid) AS false_permissions, count(*) FILTER (WHERE NOT valid) AS invalid_requests, count(*) FILTER (WHERE NOT allowed AND valid) AS false_refusals, count(*) FILTER (WHERE valid) AS valid_requests,
  count(*) FILTER (WHERE relation <> expected) AS interpretation_errors, count(changed) AS rankings, count(*) FILTER (WHERE allowed <> valid AND changed > 0) AS rankings_changed, coalesce(sum(changed) FILTER (WHERE allowed <> valid), 0)::bigint AS selections_changed FROM p GROUP BY rule)
 SELECT *, round(coalesce(false_permissions / nullif(invalid_requests, 0), 0), 9) AS false_permission_rate, round(coalesce(false_refusals / nullif(valid_requests, 0), 0), 9) AS false_refusal_rate FROM a""")
def g_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four permission rules against what is true of each request. Every 17th request declares the wrong answer to
    whether its targets are the same, which deceives even the rule that asks for all that the operation needs."""
    k = F.col("id")
    true = cases(spark, sf_dir).withColumn("valid", permits_exact()).withColumn("expected", relationship()).withColumn("fixture", F.when(F.col("op") == "rank", F.floor(k / 6) % 25))
    declared = true.withColumn("same_target", F.col("same_target") != (k % 17 == 0))
    scores = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("fixture"), (F.col("s_suppkey") % 2).alias("target"), (F.col("s_acctbal") / 10000).alias("s"))
    out = rule_comparison(declared, selection_changes(scores))
    return out.withColumns({r: F.round(r, 9) for r in ("false_permission_rate", "false_refusal_rate")})


@query(f"WITH {CORPUS}, g AS (SELECT split, count(*) FILTER (WHERE linked) = count(*) AS a, count(*) FILTER (WHERE built) = count(*) AS b FROM corpus GROUP BY split) SELECT split, a AS lineage, b AS build, CASE WHEN a AND b THEN 'pass' ELSE 'fail' END AS status FROM g")
def a_allpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst of several gates."""
    g = corpus(spark, sf_dir).groupBy("split").agg(F.bool_and("linked").alias("lineage"), F.bool_and("built").alias("build"))
    ok = lambda c: F.when(F.col(c), "pass").otherwise("fail")
    return g.withColumn("status", worst([ok("lineage"), ok("build")]))


@query(f"WITH {CORPUS}, g AS (SELECT split, count(*) FILTER (WHERE foreign_field) / count(*)::double <= 0.014 AS verified, avg((outcome = 'observed_positive')::int) AS rate FROM corpus GROUP BY split) SELECT split, verified, CASE WHEN verified THEN round(rate, 6) END AS rate FROM g")
def g_precalc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verify, then analyse: label rates are returned only where the audit found at most FOREIGN_SHARE of a split's rows
    to hold foreign fields."""
    audit = F.avg(F.col("foreign_field").cast("int")) <= FOREIGN_SHARE
    rates = corpus(spark, sf_dir).groupBy("split").agg(audit.alias("verified"), F.avg((F.col("outcome") == "observed_positive").cast("int")).alias("rate"))
    return rates.select("split", "verified", F.when(F.col("verified"), F.round("rate", 6)).alias("rate"))


@query(f"""WITH {CORPUS}, g AS (SELECT split, count(*) AS n, count(*) FILTER (WHERE outcome = 'observed_positive') AS p, count(*) FILTER (WHERE outcome = 'observed_negative') AS q, count(*) FILTER (WHERE outcome = 'censored') AS z FROM corpus GROUP BY split)
 SELECT 'outcomes' AS chart, split || ' ' || k AS label, v AS value FROM (SELECT split, unnest(['positive', 'negative', 'censored']) AS k, unnest([p, q, z]) AS v FROM g WHERE p + q + z = n)""")
def g_summarypts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a summary chart, only where the counts add up."""
    n = lambda o: many(F.col("outcome") == o)
    g = corpus(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), n("observed_positive").alias("positive"), n("observed_negative").alias("negative"), n("censored").alias("censored"))
    points = g.where("positive + negative + censored = n").drop("n").unpivot(["split"], ["positive", "negative", "censored"], "k", "value")
    return points.select(F.lit("outcomes").alias("chart"), F.concat_ws(" ", "split", "k").alias("label"), "value")
