"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source with target T and size S (words) takes each of its documents T / S times: the whole part for certain, the
fraction p by rounding. Two documents at a time pass words between them, in proportion to the chances that keep each
expectation, until one of the two fractions is 0 or 1; the other goes on. Because words and not counts are passed, a
source's words stay exactly on target until its very last document, which is rounded to the nearest; the few words
that this moves are given back to documents that met at the root.

The reduction tree: documents meet in buckets of about BUCKET by a hash of the document, each bucket leaves one
undecided document, and those meet again, so a source of any size takes log_BUCKET(n) rounds and no task sees more
than a bucket. A source is settled at the level where it has one bucket; each bucket below sends its part of
SPARES decided documents, of all sizes, along with the undecided one. Randomness is a hash of the pair, so reruns and lost executors repeat the same mix.

Defined results: null text has size 0 and is taken 0 words; a null source is a source of its own, ordered last; rows
that repeat (doc_id, source, size) are decided together and alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

#: SPARES: about so many decided documents meet at a root besides those of its own bucket.
BUCKET, SEED, CAP, SPARES = 256, 17, 3, 1024
DONE = "array<struct<mass:double,doc_id:bigint,size:bigint,up:int>>"


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """(source, source_size, items, target): shares of the whole by weight, held at cap times the source's size.

    Resharing the excess by weight until no target is above its cap ends at min(cap, level * weight); the level is
    found in one pass over the sources ordered by cap / weight. This is a table of one row per source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("items"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w.cast("double")).withColumn("most", F.col("source_size") * float(cap)).withColumn("ratio", F.col("most") / F.col("w"))
    before = Window.orderBy("ratio", "w", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    per = per.withColumn("level", left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    level = F.coalesce(F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every), F.lit(0.0))
    return per.withColumn("at", level).select("source", "source_size", "items", F.least("most", F.col("at") * F.col("w")).alias("target"))


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def pivot_pair(acc: Column, x: Column, level: int) -> Column:
    """The carried document and the next one exchange words until one of them is decided."""
    i = acc["carry"]
    to_i = F.least((1 - i["p"]) * i["mass"], x["p"] * x["mass"])
    to_x = F.least(i["p"] * i["mass"], (1 - x["p"]) * x["mass"])
    u = F.pmod(F.xxhash64(F.lit(SEED), F.lit(level), i["doc_id"], i["size"], x["doc_id"], x["size"]), F.lit(1 << 40)) / float(1 << 40)

    def moved(v: Column) -> Column:
        up = v["u"] * (v["a"] + v["b"]) < v["b"]
        i_ends = F.when(up, (1 - i["p"]) * i["mass"] <= x["p"] * x["mass"]).otherwise(i["p"] * i["mass"] <= (1 - x["p"]) * x["mass"])
        by = F.when(up, v["a"]).otherwise(-v["b"])
        inside = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
        carried = lambda e, p: F.struct(e["mass"].alias("mass"), e["doc_id"].alias("doc_id"), e["size"].alias("size"), inside(p).alias("p"))
        ended = lambda e, one: F.struct(e["mass"].alias("mass"), e["doc_id"].alias("doc_id"), e["size"].alias("size"), one.cast("int").alias("up"))
        return F.when(i_ends, F.struct(carried(x, x["p"] - by / x["mass"]).alias("carry"), F.concat(acc["done"], F.array(ended(i, up))).alias("done"))).otherwise(
            F.struct(carried(i, i["p"] + by / i["mass"]).alias("carry"), F.concat(acc["done"], F.array(ended(x, ~up))).alias("done"))
        )

    return let(F.struct(to_i.alias("a"), to_x.alias("b"), u.alias("u")), moved)


def settle(carry: Column, done: Column) -> Column:
    """At the root: round the last document to the nearest and give the words that this adds or loses back to the
    documents decided in the root's bucket, the largest that fits first, so that what stays is below a small one."""
    last = F.struct(carry["mass"].alias("mass"), carry["doc_id"].alias("doc_id"), carry["size"].alias("size"), (carry["p"] >= 0.5).cast("int").alias("up"))
    missing = (carry["p"] - (carry["p"] >= 0.5).cast("int")) * carry["mass"]

    def give(acc: Column, d: Column) -> Column:
        more, less = (d["up"] == 0) & (d["mass"] <= acc["missing"]), (d["up"] == 1) & (d["mass"] <= -acc["missing"])
        up = F.when(more, F.lit(1)).when(less, F.lit(0)).otherwise(d["up"])
        left = F.when(more, acc["missing"] - d["mass"]).when(less, acc["missing"] + d["mass"]).otherwise(acc["missing"])
        same = F.struct(d["mass"].alias("mass"), d["doc_id"].alias("doc_id"), d["size"].alias("size"), up.alias("up"))
        return F.struct(left.alias("missing"), F.concat(acc["out"], F.array(same)).alias("out"))

    start = F.struct(missing.alias("missing"), F.array(last).cast(DONE).alias("out"))
    return F.aggregate(F.sort_array(done, asc=False), start, give, lambda acc: acc["out"])


def round_level(items: DataFrame, level: int) -> DataFrame:
    """One round of the tree: (source, items, carry, done, spares), a row per bucket. items: source, items, mass, doc_id,
    size, p, spares. At the root all spares are in done; below, done keeps what the spares leave."""
    buckets = F.greatest(F.lit(1), F.ceil(F.col("items") / float(BUCKET ** (level + 1))))
    placed = items.select("source", "items", F.pmod(F.xxhash64(F.lit(SEED + level), "doc_id", "size"), buckets).alias("bucket"), F.struct((-F.col("mass")).alias("order"), "mass", "doc_id", "size", "p").alias("e"), "spares")
    met = placed.groupBy("source", "items", "bucket").agg(F.sort_array(F.collect_list("e")).alias("es"), F.flatten(F.collect_list("spares")).alias("sent"))
    es = F.transform("es", lambda e: F.struct(e["mass"].alias("mass"), e["doc_id"].alias("doc_id"), e["size"].alias("size"), e["p"].alias("p")))
    met = met.select("source", "items", es.alias("es"), "sent")
    start = F.struct(F.col("es")[0].alias("carry"), F.array().cast(DONE).alias("done"))
    done = F.aggregate(F.slice("es", 2, F.size("es")), start, lambda acc, x: pivot_pair(acc, x, level))
    met = met.select("source", "items", done.alias("r"), "sent").select("source", "items", "r.carry", F.sort_array(F.concat("r.done", "sent")).alias("all"))
    # Evenly spaced by size from a hashed start, so that many buckets send all sizes.
    step = F.greatest(F.lit(1), F.ceil(F.size("all") / F.ceil(SPARES / buckets))).cast("int")
    first = F.pmod(F.xxhash64("carry.doc_id", "carry.size"), step)
    root = F.col("items") <= BUCKET ** (level + 1)
    goes = lambda k: (k % step == first) & ~root
    return met.select("source", "items", "carry", F.filter("all", lambda d, k: ~goes(k)).alias("done"), F.filter("all", lambda d, k: goes(k)).alias("spares"))


def mix(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """sized (doc_id, source, size) -> its rows with source_size, target and copies, how often the mix takes the row."""
    targets = materialize(source_targets(sized, weights, cap), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = targets.select("source", F.col("items"), F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("p"))
    once = sized.where("size > 0").groupBy("doc_id", "source", "size").agg(F.count("*").alias("k"))
    on = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]
    items = once.join(rated, on(once, rated, "source")).where("p > 1e-12").select(once["source"], "items", (F.col("k") * F.col("size")).cast("double").alias("mass"), "doc_id", "size", "p", F.array().cast(DONE).alias("spares"))
    largest, level, decided = targets.agg(F.max("items")).first()[0] or 0, 0, []
    while largest:
        met = materialize(round_level(items, level), f"level{level}")
        root = F.col("items") <= BUCKET ** (level + 1)
        decided.append(met.where(root).select("source", F.inline(settle(F.col("carry"), F.col("done")))))
        if largest <= BUCKET ** (level + 1):
            break
        decided.append(met.where(~root).select("source", F.inline("done")))
        items, level = met.where(~root).select("source", "items", "carry.*", "spares"), level + 1
    out = sized.join(targets, on(sized, targets, "source"), "left").select("doc_id", sized["source"], "size", "source_size", "target")
    if not decided:
        return out.withColumn("copies", F.lit(0).cast("long"))
    ups = decided[0]
    for d in decided[1:]:
        ups = ups.unionByName(d)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    both = out.join(ups, on(out, ups, "doc_id", "source", "size"), "left")
    return both.select(out["doc_id"], out["source"], out["size"], "source_size", "target", (F.floor(ratio) + F.coalesce("up", F.lit(0))).cast("long").alias("copies"))


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialize(table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size")), "sized")
    return mix(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
