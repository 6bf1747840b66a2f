"""Readers and sinks over files that Spark writes from the tables, faults included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import first_reason
from ..registry import query
from ..sources import readers as R
from ..sources.sinks import write_report
from ..sources.store import scratch
from ..sources.tables import table


#: Width of the ranges of keys that go into one JSON list or object.
LIST = 20_000
#: Pages of a file whose digest is taken, so that a file fits into memory.
PAGES = 20


def text_file(rows: DataFrame, name: str, **options: str) -> str:
    path = scratch(rows.sparkSession, name)
    rows.write.options(**options).text(path)
    return path


CSV_SQL = """WITH r AS (SELECT o_orderkey % 5 AS part, o_orderkey AS k, row_number() OVER (PARTITION BY o_orderkey % 5 ORDER BY o_orderkey) + 1 AS line FROM orders),
 e AS (SELECT part, line, list_filter([CASE WHEN part = 3 THEN 'unexpected header' END, CASE WHEN k % 50 = 0 THEN 'wrong number of fields' WHEN k % 33 = 0 THEN 'price is not double' END], lambda x: x IS NOT NULL) AS errors FROM r)
 SELECT part, line::bigint AS line, array_to_string(errors, '; ') AS errors FROM e WHERE len(errors) > 0
 UNION ALL VALUES (7, 0, 'the file is empty or can''t be read'), (8, 0, 'the file is missing')
 UNION ALL SELECT -1, count(*) FILTER (WHERE len(errors) = 0), 'valid rows' FROM e"""


@query(CSV_SQL)
def src_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict CSV files: every faulty line with its file and number, files with a mark before the header or another
    header, one that can't be unpacked and one that isn't there (line 0); and the number of valid rows."""
    k = F.col("o_orderkey")
    price = F.when(k % 33 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    line = F.concat_ws(",", k.cast("string"), F.concat(F.lit('"st""'), F.col("o_orderstatus"), F.lit('"')), price)
    line = F.when(k % 50 == 0, F.concat(line, F.lit(",extra"))).otherwise(line)
    rows = table(spark, sf_dir, "orders").select((k % 5).alias("part"), k.alias("at"), line.alias("value"))
    header = F.when(F.col("id") == 1, "\ufeffkey,status,price").when(F.col("id") == 3, "status,key,price").otherwise("key,status,price")
    rows = rows.unionAll(spark.range(5).select(F.col("id"), F.lit(-1), header))
    path = scratch(spark, "csv")
    rows.repartition(5, "part").sortWithinPartitions("part", "at").select("part", "value").write.partitionBy("part").text(path)
    spark.range(1).select(F.lit("no archive").alias("value")).coalesce(1).write.text(f"{path}/part=7")
    bad = spark._jvm.org.apache.hadoop.fs.Path(R.listed(spark, f"{path}/part=7")[0])
    bad.getFileSystem(spark._jsc.hadoopConfiguration()).rename(bad, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part=7/bad.csv.gz"))
    got = R.read_csv(spark, [f"{path}/part={i}" for i in (0, 1, 2, 3, 4, 7, 8)], {"key": "bigint", "status": "string", "price": "double"}, ((~F.col("status").startswith('st"'), "status is not quoted"),))
    got = got.select(F.regexp_extract("_file", "part=([0-9]+)", 1).cast("int").alias("part"), F.coalesce("_line", F.lit(0)).alias("line"), "_errors")
    faulty = got.where(F.size("_errors") > 0).select("part", "line", F.array_join("_errors", "; ").alias("errors"))
    return faulty.unionAll(got.where(F.size("_errors") == 0).agg(F.lit(-1), F.count("*"), F.lit("valid rows")))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE user_id % 9 = 4) AS short_rows, count(*) FILTER (WHERE user_id % 9 = 5) AS not_finite, round(sum(CASE WHEN user_id % 9 NOT IN (4, 5) THEN value END), 3) AS total FROM events")
def src_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitespace-delimited numbers with blank lines, short lines and words among them."""
    e = table(spark, sf_dir, "events")
    u = F.col("user_id")
    line = F.when(u % 9 == 4, u.cast("string")).otherwise(F.concat_ws("   ", u.cast("string"), F.when(u % 9 == 5, "NaN").otherwise(F.col("value").cast("string")), F.lit("1")))
    path = text_file(e.select(F.explode(F.array(line, F.lit("  "))).alias("value")), "numbers")
    got = R.read_numbers(spark, path, ["unit", "value", "setting"])
    has = lambda m: F.sum(F.array_contains("_errors", m).cast("long"))
    return got.agg(F.count("*").alias("n"), has("expected 3 fields").alias("short_rows"), has("value is not finite").alias("not_finite"), F.round(F.sum(F.when(F.size("_errors") == 0, F.col("value"))), 3).alias("total"))


@query("SELECT count(*) AS n, round(sum(value), 3) AS total FROM events WHERE event_id % 8 <> 0")
def src_gz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gzip trace; short lines are dropped."""
    line = F.when(F.col("event_id") % 8 == 0, "7").otherwise(F.concat_ws(" ", F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.col("value").cast("string")))
    path = text_file(table(spark, sf_dir, "events").select(line.alias("value")), "trace", compression="gzip")
    return R.read_trace(spark, path, ["job", "task", "value"], "Time").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("SELECT row_number() OVER (ORDER BY event_id) AS position, value FROM events")
def src_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One number a line, aligned by position in the file."""
    rows = table(spark, sf_dir, "events").orderBy("event_id").select(F.col("value").cast("string").alias("value"))
    return R.read_vector(spark, text_file(rows, "vector"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE s_suppkey % 6 = 0) AS incomplete FROM supplier")
def src_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests as JSON lists with required fields. A list is of one nation and one range of LIST keys, so that a hot
    nation is many lists of bounded length."""
    s = table(spark, sf_dir, "supplier")
    each = F.struct(F.col("s_name").alias("anchor_id"), F.when(F.col("s_suppkey") % 6 == 0, "").otherwise("2024-01-01T00:00:00").alias("start"), F.lit("2024-01-02T00:00:00").alias("end"))
    lists = s.groupBy("s_nationkey", F.floor(F.col("s_suppkey") / LIST).alias("block")).agg(F.to_json(F.collect_list(each)).alias("value")).select("value")
    path = scratch(spark, "manifests")
    lists.write.option("maxRecordsPerFile", 1).text(path)
    got = R.read_manifest(spark, path, ["anchor_id", "start", "end"])
    return got.agg(F.count("*").alias("n"), F.sum((F.size("_errors") > 0).cast("long")).alias("incomplete"))


@query("SELECT o_custkey % 20 AS run, count(*) AS n, round(sum(o_totalprice / 1000), 1) AS seconds FROM orders GROUP BY 1")
def src_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested run records back as rows. An object is of one customer and one range of LIST keys, so that a hot customer
    is many objects of bounded length."""
    record = F.struct(F.col("o_orderkey").cast("string").alias("commit"), (F.col("o_totalprice") / 1000).alias("seconds"))
    runs = table(spark, sf_dir, "orders").groupBy("o_custkey", F.floor(F.col("o_orderkey") / LIST).alias("block")).agg(F.collect_list(record).alias("records")).select((F.col("o_custkey") % 20).cast("string").alias("run"), "records")
    path = scratch(spark, "runs")
    runs.write.json(path)
    return R.read_runs(spark, path).groupBy(F.col("run").cast("bigint").alias("run")).agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 1).alias("seconds"))


@query("""WITH f AS (SELECT page_id // 20 AS block, string_agg(coalesce(html, '') || chr(10), '' ORDER BY page_id) AS content FROM pages GROUP BY 1)
 SELECT block, strlen(content)::bigint AS bytes, sha256(content) AS sha256, md5(content) AS md5, block % 7 <> 3 AS matches FROM f""")
def src_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and sizes of files against the values that a manifest pins: all pages, PAGES of them a file. The
    manifest's value of every seventh file is that of other contents."""
    block = F.floor(F.col("page_id") / PAGES).alias("block")
    pages = table(spark, sf_dir, "pages").select(block, "page_id", F.coalesce("html", F.lit("")).alias("value"))
    path = scratch(spark, "files")
    pages.repartition("block").sortWithinPartitions("block", "page_id").select("block", "value").write.partitionBy("block").option("maxRecordsPerFile", 0).text(path)
    content = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", "value"))), lambda r: F.concat(r["value"], F.lit("\n"))), "")
    pinned = F.sha1(F.when(F.col("block") % 7 == 3, F.lit("other contents")).otherwise(content))
    manifest = pages.groupBy("block").agg(pinned.alias("pinned"))
    files = R.file_digests(spark, path).join(manifest, "block", "left")
    return files.select(F.col("block").cast("long").alias("block"), "bytes", "sha256", "md5", F.coalesce(F.col("sha1") == F.col("pinned"), F.lit(False)).alias("matches"))


CATALOG_SQL = """WITH m AS (SELECT page_id AS i, 'set-' || page_id AS name, CASE WHEN page_id % 19 = 0 THEN NULL ELSE url END AS source, page_id % 17 = 0 AS other, page_id % 13 = 0 AS boundless FROM pages),
 e AS (SELECT *, CASE WHEN other THEN 'invalid dataset identity' WHEN boundless THEN 'no claim boundary' WHEN source IS NULL OR NOT starts_with(source, 'https://') THEN 'no canonical HTTPS source' END AS error FROM m),
 l AS (SELECT i, CASE i % 4 WHEN 2 THEN 'deferred' ELSE 'accepted' END AS status, i % 23 <> 0 AS pinned, i % 29 <> 0 AS same FROM m WHERE i % 4 <> 3),
 d AS (SELECT e.i, error, status, CASE WHEN error IS NOT NULL THEN 'invalid manifest' WHEN status IS NULL THEN 'no decision' WHEN status <> 'accepted' THEN status WHEN NOT pinned THEN 'artifact not pinned' WHEN NOT same THEN 'artifact differs' ELSE 'admitted' END AS verdict FROM e LEFT JOIN l USING (i))
 SELECT verdict, coalesce(error, '') AS error, count(*) AS n FROM d GROUP BY ALL"""


def catalog_verdicts(manifests: DataFrame, ledger: DataFrame) -> DataFrame:
    """manifests (name, and as read dataset_id, claim_boundary, source.retrieval_reference or canonical_source, digest) and
    ledger (dataset_id, status, sha256) -> (name, error, verdict). Manifests without a decision are not admitted."""
    c = F.col
    reference = F.coalesce(c("source.retrieval_reference"), c("canonical_source"))
    error = first_reason((c("dataset_id") != c("name"), "invalid dataset identity"), (F.trim("claim_boundary") == "", "no claim boundary"), (~reference.startswith("https://"), "no canonical HTTPS source"))
    rows = manifests.withColumn("error", error).join(ledger.select(c("dataset_id").alias("name"), "status", "sha256"), "name", "left")
    verdict = F.coalesce(F.when(c("error").isNotNull(), "invalid manifest"), F.when(c("status").isNull(), "no decision"), F.when(c("status") != "accepted", c("status")), F.when(c("sha256").isNull(), "artifact not pinned"), F.when(c("sha256") != c("digest"), "artifact differs"), F.lit("admitted"))
    return rows.select("name", "error", verdict.alias("verdict"))


@query(CATALOG_SQL)
def src_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory of dataset manifests with required fields and an HTTPS source, each against the ledger of decisions
    and the digest that it pins; faults are injected by the id."""
    i, name = F.col("page_id"), F.concat(F.lit("set-"), F.col("page_id").cast("string"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(i % 19 != 0, F.col("url")).alias("url"))
    nested = i % 5 == 0
    path, decisions = scratch(spark, "catalog"), scratch(spark, "ledger")
    pages.select(
        name.alias("name"), F.when(i % 17 == 0, "other").otherwise(name).alias("dataset_id"), F.when(i % 13 != 0, "public pages").otherwise(" ").alias("claim_boundary"),
        F.when(nested, F.struct(F.col("url").alias("retrieval_reference"))).alias("source"), F.when(~nested, F.col("url")).alias("canonical_source"),
    ).write.json(path)
    digest = F.sha2(F.concat_ws("\n", name, F.col("url")), 256)
    pages.where(i % 4 != 3).select(name.alias("dataset_id"), F.when(i % 4 == 2, "deferred").otherwise("accepted").alias("status"), F.when(i % 23 != 0, F.when(i % 29 == 0, F.sha2(F.lit("other"), 256)).otherwise(digest)).alias("sha256")).write.json(decisions)
    read = spark.read.json(path, schema="name string, dataset_id string, claim_boundary string, source struct<retrieval_reference:string>, canonical_source string")
    read = read.withColumn("digest", F.sha2(F.concat_ws("\n", "name", F.coalesce("source.retrieval_reference", "canonical_source")), 256))
    verdicts = catalog_verdicts(read, spark.read.json(decisions, schema="dataset_id string, status string, sha256 string"))
    return verdicts.groupBy("verdict", F.coalesce("error", F.lit("")).alias("error")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS status, count(*) AS n, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END::bigint AS nulls FROM orders GROUP BY o_orderstatus")
def snk_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as JSON with sorted keys and nulls kept, read back."""
    report = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")).withColumn("maybe", F.when(F.col("status") != "P", 1))
    lines = spark.read.text(write_report(report))
    back = lines.select(F.from_json("value", "status string, n bigint, maybe int").alias("r"), F.col("value").contains('"maybe":null').cast("long").alias("nulls"))
    return back.select("r.status", "r.n", "nulls")
