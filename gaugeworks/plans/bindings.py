"""How the driver's tables stand for scored rows, events, changes and corpora, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import churn_risk
from ..sources.tables import table

LABELLED = """
labelled AS (
  SELECT d.doc_id AS id, f.family, f.y, round(1 - exp(-0.002 * d.n_chars), 6) AS s
  FROM documents d JOIN (SELECT doc_id, 'quality' AS family, quality AS y FROM labels
                         UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) f ON f.doc_id = d.doc_id)"""

SCORED = """
scored AS (
  SELECT l_linestatus AS family, l_orderkey AS unit, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
         round(1.0::double / 3 + (l_linenumber - 4) * 0.001::double, 9) AS s, round(l_discount * 5, 9) AS baseline
  FROM lineitem)"""

CORPUS = """
corpus AS (
  SELECT o_orderkey AS row_id, o_custkey AS grp, o_orderdate AS score_time,
         CASE o_orderstatus WHEN 'F' THEN 'observed_positive' WHEN 'O' THEN 'observed_negative' ELSE 'censored' END AS outcome,
         CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'calibration_fit'
              WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'calibration_gate' ELSE 'test' END AS split,
         round(least(o_totalprice / 500000, 1), 6) AS s,
         o_orderkey % 97 <> 0 AS window_complete, o_orderkey % 89 <> 0 AS monitored, o_orderkey % 83 <> 0 AS built,
         o_orderkey % 79 <> 0 AS linked, o_orderkey % 73 = 0 AS late_field, o_orderkey % 71 = 0 AS foreign_field,
         CASE WHEN o_orderkey % 67 = 0 THEN 'h7' ELSE 'h14' END AS horizon, CASE WHEN o_orderkey % 61 = 0 THEN '' ELSE 'v1' END AS threshold_version,
         CASE WHEN o_orderkey % 59 = 0 THEN NULL ELSE 'window cut' END AS censor_reason,
         CASE WHEN o_orderkey % 53 = 0 THEN 'returns' ELSE 'orders' END AS system,
         CASE WHEN o_orderkey % 47 = 0 THEN 'fit' WHEN o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' THEN 'fit'
              WHEN o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '2000-01-01' THEN 'gate' END AS evidence,
         CASE WHEN o_orderkey % 43 = 0 THEN '' ELSE 'ledger' END AS source_system, o_orderkey % 41 = 0 AS private_data,
         CASE WHEN o_orderkey % 37 = 0 THEN o_orderdate ELSE TIMESTAMP '1990-01-01' END AS predeclared_at,
         CASE WHEN o_orderkey % 31 = 0 THEN ' ' ELSE 'public' END AS release_scope, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 'report' END AS artifact
  FROM orders)"""

#: The frozen lane of a pilot.
PROFILE = {"system_id": "orders", "service_id": "ledger", "workload_reference": "report", "horizon_rule": "h14", "outcome_threshold_rule": "v1", "capture_schema_version": "1", "allowed_evidence_scope": "public"}

LANES = """
lanes AS (
  SELECT row_id, outcome, linked, concat_ws(',', CASE WHEN system IS DISTINCT FROM 'orders' THEN 'system_id' END, CASE WHEN source_system IS DISTINCT FROM 'ledger' THEN 'service_id' END,
    CASE WHEN artifact IS DISTINCT FROM 'report' THEN 'workload_reference' END, CASE WHEN horizon IS DISTINCT FROM 'h14' THEN 'horizon_rule' END, CASE WHEN threshold_version IS DISTINCT FROM 'v1' THEN 'outcome_threshold_rule' END,
    CASE WHEN row_id % 23 = 0 THEN 'capture_schema_version' END, CASE WHEN release_scope IS DISTINCT FROM 'public' THEN 'allowed_evidence_scope' END) AS differing FROM corpus)"""

#: Splits of the corpus, in order; each ends where the next begins.
SPLITS = {"train": ("1990-01-01", "1998-01-01"), "calibration_fit": ("1998-01-01", "1999-01-01"), "calibration_gate": ("1999-01-01", "2000-01-01"), "test": ("2000-01-01", "2100-01-01")}


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small scored table with two families and a unique id."""
    labels = table(spark, sf_dir, "labels")
    each = labels.select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("family"), F.col("quality").alias("y")), F.struct(F.lit("toxic").alias("family"), F.col("toxic").alias("y")))).alias("f"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return docs.join(each, "doc_id").select(F.col("doc_id").alias("id"), "f.family", "f.y", F.round(churn_risk(F.col("n_chars")), 6).alias("s"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large scored table: a calibrated candidate s and a baseline, two families, repeated ids."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("family"), F.col("l_orderkey").alias("unit"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        F.round(F.lit(1.0) / 3 + (F.col("l_linenumber") - 4) * 0.001, 9).alias("s"), F.round(F.col("l_discount") * 5, 9).alias("baseline"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus rows with outcome, split, evidence flags and injected faults."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    t = F.col("o_orderdate")
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    return o.select(
        k.alias("row_id"), F.col("o_custkey").alias("grp"), t.alias("score_time"),
        F.when(F.col("o_orderstatus") == "F", "observed_positive").when(F.col("o_orderstatus") == "O", "observed_negative").otherwise("censored").alias("outcome"),
        F.when(t < day("1998-01-01"), "train").when(t < day("1999-01-01"), "calibration_fit").when(t < day("2000-01-01"), "calibration_gate").otherwise("test").alias("split"),
        F.round(F.least(F.col("o_totalprice") / 500000, F.lit(1.0)), 6).alias("s"),
        *((k % m != 0).alias(n) for n, m in (("window_complete", 97), ("monitored", 89), ("built", 83), ("linked", 79))),
        *((k % m == 0).alias(n) for n, m in (("late_field", 73), ("foreign_field", 71))),
        F.when(k % 67 == 0, "h7").otherwise("h14").alias("horizon"), F.when(k % 61 == 0, "").otherwise("v1").alias("threshold_version"),
        F.when(k % 59 != 0, "window cut").alias("censor_reason"),
        F.when(k % 53 == 0, "returns").otherwise("orders").alias("system"),
        F.when((k % 47 == 0) | ((t >= day("1998-01-01")) & (t < day("1999-01-01"))), "fit").when((t >= day("1999-01-01")) & (t < day("2000-01-01")), "gate").alias("evidence"),
        F.when(k % 43 == 0, "").otherwise("ledger").alias("source_system"), (k % 41 == 0).alias("private_data"),
        F.when(k % 37 == 0, t).otherwise(day("1990-01-01")).alias("predeclared_at"),
        F.when(k % 31 == 0, " ").otherwise("public").alias("release_scope"), F.when(k % 29 != 0, "report").alias("artifact"),
    )


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus rows' captures with their seven lane fields."""
    named = {"system": "system_id", "source_system": "service_id", "artifact": "workload_reference", "horizon": "horizon_rule", "threshold_version": "outcome_threshold_rule", "release_scope": "allowed_evidence_scope"}
    schema = F.when(F.col("row_id") % 23 == 0, "2").otherwise("1").alias("capture_schema_version")
    return corpus(spark, sf_dir).select("row_id", "outcome", "linked", *(F.col(c).alias(n) for c, n in named.items()), schema)
