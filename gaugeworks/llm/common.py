"""What several operators share: the shared folder, written tables, hashes and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as all word rules here see it: blank and \x09-\x0D. bytes.split() without arguments uses exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session without the setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gaugeworks-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, getattr(df, "_written_to", None)
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where.getParent(), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id"):
    """True for ids whose crc32 (of the id as text) leaves 2 modulo 4. A null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of bigints -> (node, component): the least node that each node reaches. Nodes without an edge are absent.

    Alternates large-star and small-star steps. Minima are map-side combined, and each join's two sides are
    exchanged for that join alone, so that adaptive execution can split a hub with many neighbours.
    """

    def minima(pairs: DataFrame, name: str) -> DataFrame:
        return materialize(pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m")), name)

    def stamp(d: DataFrame):
        return d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = stamp(now)
    while seen[0]:
        both = now.selectExpr("a AS u", "b AS v").unionAll(now.selectExpr("b AS u", "a AS v"))
        low = minima(both, "low")
        large = materialize(both.join(low, "u").where("v > u").selectExpr("m AS a", "v AS b").where("a <> b").distinct(), "large")
        down = large.selectExpr("b AS u", "a AS v")
        low2 = minima(down, "low2")
        small = down.join(low2, "u")
        nxt = materialize(small.selectExpr("m AS a", "v AS b").unionAll(low2.selectExpr("m AS a", "u AS b")).where("a <> b").distinct(), "edges")
        for old in (now, low, large, low2):
            discard(old)
        was, now, seen = seen, nxt, stamp(nxt)
        if was == seen:
            break
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return roots.unionAll(now.selectExpr("b AS node", "a AS component"))
