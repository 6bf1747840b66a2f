"""Strict readers: text in, typed columns and a list of errors for each row out; nothing is dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import violations


def listed(spark: SparkSession, path: str) -> list[str]:
    """The files of a folder, of the folders in it and of a pattern, or the path itself where there is nothing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out, found = [], list(store.globStatus(p) or [])
    while found:
        status = found.pop()
        if status.getPath().getName()[0] in "_.":
            continue
        if status.isDirectory():
            found += store.listStatus(status.getPath())
        else:
            out.append(status.getPath().toString())
    return sorted(out) or [path]


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(_file, _line, value) of text files that may be split: a line's number is the lines of the file's splits before its
    own and its place in that. Files that can't be opened give no line."""
    lines = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").text(paths)
    lines = lines.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), "value", F.monotonically_increasing_id().alias("_id"))
    # A split is read by one task in order, so its ids follow each other.
    splits = lines.groupBy("_file", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_k"))
    before = F.sum("_k").over(Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("_file", "_at", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return lines.join(splits, ["_file", "_at"]).select("_file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("_line"), "value")


def read_csv(spark: SparkSession, path: str | list[str], types: dict[str, str], rules: tuple[tuple[Column, str], ...] = ()) -> DataFrame:
    """types: the pinned header and each column's type. Adds _file, _line and _errors: header, arity, types and rules.

    Every value is read as text first, so a bad one is an error of its row and not of the job. A line is a row; the first
    of each file is compared with the pinned header, and where it differs, that is an error of all rows of the file. A
    file of the list that is missing, empty or can't be read is a row with an error and no line."""
    names = list(types)
    files = [f for p in ([path] if isinstance(path, str) else path) for f in listed(spark, p)]
    exists = [f for f in files if spark._jvm.org.apache.hadoop.fs.Path(f).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f))]
    schema = ", ".join(f"`{n}` string" for n in names) + ", _broken string"
    nothing = spark.createDataFrame([], "_file string, _line long, value string")
    lines = numbered_lines(spark, exists) if exists else nothing
    heads = lines.where("_line = 1").select("_file", F.regexp_replace("value", "^\ufeff|\r$", "").alias("_head"))
    parsed = F.from_csv(F.regexp_replace("value", "\r$", ""), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "escape": '"'})
    rows = lines.where("_line > 1").select("_file", "_line", (F.trim("value") == "").alias("_blank"), parsed.alias("_row")).select("_file", "_line", "_blank", "_row.*")
    rows = rows.join(heads.where(F.col("_head") != ",".join(names)), "_file", "left")
    bad_header, broken = F.col("_head").isNotNull(), F.col("_broken").isNotNull() | F.col("_blank")
    typed = [F.col(n).try_cast(t).alias(n) if t != "string" else F.col(n) for n, t in types.items()]
    casts = [(~broken & F.col(n).isNotNull() & F.col(n).try_cast(t).isNull(), f"{n} is not {t}") for n, t in types.items() if t != "string"]
    missing = [(~broken & F.col(n).isNull(), f"{n} is missing") for n in names]
    checked = rows.withColumn("_errors", violations((bad_header, "unexpected header"), (broken, "wrong number of fields"), *missing, *casts))
    out = checked.select(*typed, "_file", "_line", "_errors")
    out = out.withColumn("_errors", F.concat("_errors", violations(*((F.coalesce(c, F.lit(False)), m) for c, m in rules)))) if rules else out
    # What was asked for beside what was read.
    asked = spark.createDataFrame([(f, f in exists) for f in files], "_asked string, _there boolean")
    read = heads.select("_file", F.lit(True).alias("_read"))
    lost = asked.join(read, F.regexp_replace("_asked", "^file:/+", "/") == F.regexp_replace("_file", "^file:/+", "/"), "left").where("_read IS NULL")
    said = F.array(F.when(F.col("_there"), "the file is empty or can't be read").otherwise("the file is missing"))
    return out.unionByName(lost.select(*(F.lit(None).cast(t).alias(n) for n, t in types.items()), F.col("_asked").alias("_file"), F.lit(None).cast("long").alias("_line"), said.alias("_errors")))


def read_numbers(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Whitespace-delimited numbers, gzip or plain; blank lines are skipped. Adds _errors."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(parts.alias("p"))
    value = lambda k: F.get("p", F.lit(k)).try_cast("double")
    finite = lambda k: value(k).isNull() | F.isnan(value(k)) | (F.abs(value(k)) == float("inf"))
    wrong = (F.size("p") != len(names), f"expected {len(names)} fields")
    errors = violations(wrong, *(((F.size("p") == len(names)) & finite(k), f"{n} is not finite") for k, n in enumerate(names)))
    return rows.select(*(value(k).alias(n) for k, n in enumerate(names)), errors.alias("_errors"))


def read_trace(spark: SparkSession, path: str, names: list[str], header: str) -> DataFrame:
    """A gzip trace with one header line; lines with too few fields are dropped, as the format allows. A gzip file is
    one partition, so the rows are dealt out anew."""
    lines = spark.read.text(path).repartition(spark.sparkContext.defaultParallelism)
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.col("value").startswith(header)).select(parts.alias("p")).where(F.size("p") >= len(names))
    return rows.select(*(F.get("p", F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(names)))


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """One number a line, with its position in the files' order."""
    rows = spark.read.text(path).select(F.trim("value").try_cast("double").alias("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    blocks = rows.groupBy("_file", "_block").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_row"))
    return rows.join(blocks.select("_file", "_block", before.alias("_before")), ["_file", "_block"]).select((F.col("_before") + inside).alias("position"), "value")


def read_manifest(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A JSON list of objects with required string fields; malformed files fail, missing fields are errors of a row."""
    schema = ", ".join(f"`{n}` string" for n in required)
    rows = spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")
    return rows.withColumn("_errors", violations(*((F.coalesce(F.trim(n), F.lit("")) == "", f"{n} is required") for n in required)))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Nested run records as rows: (run, commit, seconds)."""
    schema = "run string, records array<struct<commit:string,seconds:double>>"
    rows = spark.read.json(path, schema=schema)
    return rows.select("run", F.explode("records").alias("r")).select("run", "r.commit", "r.seconds")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, md5, sha1) of each file and the columns that its folders name, for comparison with pinned values."""
    files = spark.read.format("binaryFile").load(path)
    named = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]
    return files.select("path", *named, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"), F.sha1("content").alias("sha1"))
