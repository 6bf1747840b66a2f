"""The evidence store: events, definitions, signals and outcomes as Parquet tables laid out by a hash of their key.

A batch is applied in two steps, and each can be repeated. First its plan is written: every row with its action (insert,
same, conflict or rejected), the reason and the slot of its key. A complete plan is final: applying the same commit again
reads it and decides nothing anew. A slot's first part is its base. While that is small, it is written again with its new
rows, first to a folder of its own and from there over just those partitions; a slot with a larger base gets a part of
its own for each commit, so that no stored row is written again. The plan says which. What a lost driver left half done
is done again from the plan or from that folder. Stored rows are never changed: a key with other content is a conflict
and stays out.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the folder that all executors share; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gaugeworks-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{uuid.uuid4().hex}/{name}"


#: Bytes up to which a slot's base is written again with its new rows.
BASE_BYTES = 1 << 20
#: Bits of the filter that keeps stored rows of other keys out of a batch's join.
FILTER_BITS = 1 << 24


def content(df: DataFrame, leave: tuple[str, ...] = ()) -> Column:
    """A digest of a row's columns but those in `leave`, whatever their order."""
    return F.unhex(F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns) if c not in leave)), {"ignoreNullFields": "false"}), 256))


def among(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are in wanted, and by chance some others: a join that needs no exchange of the rows. With very
    many wanted keys, nearly all rows pass."""
    at = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    word, bit = F.shiftright(at, 6), F.expr("shiftleft(1L, cast(_at % 64 as int))")
    words = wanted.select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    return rows.withColumn("_at", at).withColumn("_place", word).join(F.broadcast(words), (F.col("_place") == F.col("_word")) & (F.col("_bits").bitwiseAND(bit) != 0), "left_semi").drop("_at", "_place")


#: Key of each table. Outcomes have none of their own: equal ones are one, others stand beside each other.
KEYS = {"events": ["event_id"], "definitions": ["definition_id"], "signals": ["event_id", "strategy", "version"], "outcomes": ["content"]}


@dataclass
class EvidenceStore:
    """slots is fixed when a table is first written. order: a batch's column that says which of its rows came first."""

    spark: SparkSession
    path: str
    slots: int = 64

    def where(self, table: str) -> str:
        return f"{self.path}/{table}"

    def exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def slot(self, *keys) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.slots)).cast("int")

    def read(self, table: str, slots: list[int] | None = None) -> DataFrame | None:
        """A stored table, or its given slots, which are folders; None before its first row."""
        if not self.exists(self.where(table)):
            return None
        rows = self.spark.read.parquet(self.where(table))
        return (rows if slots is None else rows.where(F.col("slot").isin(slots))).drop("slot", "part")

    def bases(self, table: str) -> list[int]:
        """The slots that are too large to be written again."""
        fs = self.spark._jvm.org.apache.hadoop.fs.Path
        files = fs(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        sizes = {k: files.getContentSummary(fs(p)).getLength() for k in range(self.slots) if self.exists(p := f"{self.where(table)}/slot={k}")}
        return [k for k, size in sizes.items() if size > BASE_BYTES]

    def ledger(self, table: str) -> DataFrame:
        """All plans of a table: what became of every row that came."""
        return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.path}/_plans/{table}")

    def get(self, table: str, *key) -> DataFrame:
        """The rows of one key; only its slot is read."""
        rows = self.spark.read.parquet(self.where(table))
        kinds = dict(rows.dtypes)
        wanted = [F.lit(v).cast(kinds[k]) for k, v in zip(KEYS[table], key, strict=True)]
        slot = self.spark.range(1).select(self.slot(*wanted)).first()[0]
        for k, v in zip(KEYS[table], wanted, strict=True):
            rows = rows.where(F.col(k) == v)
        return rows.where(F.col("slot") == slot).drop("slot", "part")

    def apply(self, table: str, batch: DataFrame, commit: str, order: str | None = None) -> DataFrame:
        """Inserts the batch's new keys and returns its plan. commit names the batch: a repetition changes nothing."""
        plan_at, done_at = f"{self.path}/_plans/{table}/{commit}", f"{self.path}/_done/{table}/{commit}"
        if not self.exists(f"{plan_at}/_SUCCESS"):
            part = F.when(F.col("slot").isin(self.bases(table)), f"commit {commit}").otherwise("base")
            self.planned(table, batch, order).withColumn("part", part).write.mode("overwrite").parquet(plan_at)
        plan = self.spark.read.parquet(plan_at)
        if not self.exists(done_at):
            self.insert(table, plan, f"{self.path}/_next/{table}/{commit}")
            self.spark.range(1).write.mode("overwrite").parquet(done_at)
        return plan

    def planned(self, table: str, batch: DataFrame, order: str | None) -> DataFrame:
        """The batch's rows with content, action, reason and slot; equal rows are one, with how often it came as `times`.
        Of a key's contents the first one counts; the others conflict with it."""
        keys, rows = KEYS[table], self.checked(table, batch)
        rows = rows.withColumn("content", content(batch, (order,) if order else ()))
        rows = rows.withColumn("reason", F.coalesce("reason", *(F.when(F.col(k).isNull(), "the key is missing") for k in keys)))
        ahead = F.struct(*([order] if order else []), "content")
        whole = F.struct(*(F.col(f"`{c}`") for c in batch.columns))
        rows = rows.groupBy("content", "reason").agg(F.count("*").alias("times"), F.min_by(whole, ahead).alias("_row")).select("content", "reason", "times", "_row.*")
        first = rows.where("reason IS NULL").groupBy(*keys).agg(F.min_by("content", ahead).alias("_first"))
        held = F.lit(b"") if table == "outcomes" else F.col("content")
        stored = self.read(table)
        first = first.withColumn("_stored", F.lit(None).cast("binary")) if stored is None else first.join(among(stored.select(*keys, held.alias("_stored")), (rows if table == "outcomes" else batch).select(*keys), keys), keys, "left")
        rows = rows.join(first, keys, "left")
        stored, counts = F.col("_stored"), F.coalesce("_stored", "_first")
        same = stored.isNotNull() & ((stored == F.col("content")) | F.lit(table == "outcomes"))
        action = F.when(F.col("reason").isNotNull(), "rejected").when(same, "same").when(counts != F.col("content"), "conflict").otherwise("insert")
        return rows.withColumn("action", action).withColumn("slot", self.slot(*keys)).drop("_first", "_stored")

    def checked(self, table: str, batch: DataFrame) -> DataFrame:
        """Adds the reason why a row may not be stored, and fills the version of outcomes where one signal can be meant."""
        nothing = F.lit(None).cast("string")
        if table == "signals":
            events, definitions = self.read("events"), self.read("definitions")
            out = batch if events is None else batch.join(events.select("event_id", F.lit(True).alias("_event")), "event_id", "left")
            out = out if definitions is None else out.join(definitions.select("definition_id", F.lit(True).alias("_defined")), "definition_id", "left")
            no = lambda df, c: F.lit(True) if df is None else F.col(c).isNull()
            reason = F.when(no(events, "_event"), "unknown event").when(F.col("score").isNotNull() & no(definitions, "_defined"), "unknown definition")
            return out.withColumn("reason", reason).select(*batch.columns, "reason")
        if table == "outcomes":
            signals = self.read("signals")
            if signals is None:
                return batch.withColumn("reason", F.lit("no signal"))
            per = signals.groupBy("event_id", "strategy").agg(F.collect_set(F.struct("version", "definition_id")).alias("_versions"))
            out = batch.join(per, ["event_id", "strategy"], "left")
            meant = F.when(F.col("version").isNull(), F.col("_versions")).otherwise(F.filter("_versions", lambda v: v["version"] == F.col("version")))
            out = out.withColumn("_meant", meant)
            differs = F.exists("_meant", lambda v: ~v["definition_id"].eqNullSafe(F.col("definition_id")))
            reason = F.when(F.col("_versions").isNull(), "no signal").when(F.size("_meant") == 0, "no such version").when(F.size("_meant") > 1, "a version is required").when(differs, "another definition")
            filled = F.coalesce("version", F.when(reason.isNull(), F.get("_meant", F.lit(0))["version"]))
            return out.withColumn("reason", reason).withColumn("version", filled).select(*batch.columns, "reason")
        return batch.withColumn("reason", nothing)

    def insert(self, table: str, plan: DataFrame, staged: str) -> None:
        """New rows as parts of their own, or in small slots the base written over with its stored and its new rows."""
        keys = KEYS[table]
        new = plan.where("action = 'insert'").drop("action", "reason", "times")
        rows = new.where("part <> 'base'")
        if not rows.isEmpty():
            self.put(table, rows)
        new = new.where("part = 'base'")
        touched = sorted(r["slot"] for r in new.select("slot").distinct().collect())  # at most `slots` numbers
        if not touched:
            return
        if not self.exists(f"{staged}/_SUCCESS"):
            rows = new
            if (stored := self.read(table, touched)) is not None:
                rows = new.unionByName(stored.join(new.select(*keys), keys, "left_anti").withColumn("slot", self.slot(*keys)).withColumn("part", F.lit("base")), allowMissingColumns=True)
            rows.hint("rebalance", "slot").write.mode("overwrite").parquet(staged)
        self.put(table, self.spark.read.parquet(staged))
        self.delete(staged)

    def put(self, table: str, rows: DataFrame) -> None:
        rows.hint("rebalance", "slot").write.partitionBy("slot", "part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.where(table))
