"""Audits of label tables, change histories, trajectories and sensor streams; windows in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.metrics import running
from ..operators.order import adjacent_gaps, at_ranks, split_at_fraction
from ..registry import query
from ..sources.tables import table

MODES = "modes AS (SELECT *, l_returnflag = 'R' AS failure, l_discount > 0.08 AS m1, l_tax > 0.06 AS m2, l_quantity > 45 AS m3, l_linenumber = 7 AS m4, l_extendedprice > 90000 AS m5 FROM lineitem)"


def moded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (c("l_returnflag") == "R").alias("failure"), (c("l_discount") > 0.08).alias("m1"), (c("l_tax") > 0.06).alias("m2"), (c("l_quantity") > 45).alias("m3"), (c("l_linenumber") == 7).alias("m4"), (c("l_extendedprice") > 90000).alias("m5")
    )


def total(condition) -> F.Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


AUDIT_SQL = """SELECT count(*) AS row_count, sum(failure::int)::bigint AS failures, sum(m1::int)::bigint AS m1, sum(m2::int)::bigint AS m2, sum(m3::int)::bigint AS m3, sum(m4::int)::bigint AS m4, sum(m5::int)::bigint AS m5,
 sum((m1::int + m2::int + m3::int + m4::int + m5::int > 1)::int)::bigint AS multi_mode, sum((failure AND NOT (m1 OR m2 OR m3 OR m4 OR m5))::int)::bigint AS failure_without_mode,
 sum((NOT failure AND (m1 OR m2 OR m3 OR m4 OR m5))::int)::bigint AS mode_without_failure FROM modes"""


@query(f"WITH {MODES} {AUDIT_SQL}")
def a_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of a composite label in one pass."""
    m = [f"m{k}" for k in range(1, 6)]
    count = sum((F.col(x).cast("int") for x in m[1:]), F.col("m1").cast("int"))
    return moded(spark, sf_dir).agg(F.count("*").alias("row_count"), total(F.col("failure")).alias("failures"), *(total(F.col(x)).alias(x) for x in m), total(count > 1).alias("multi_mode"), total(F.col("failure") & (count == 0)).alias("failure_without_mode"), total(~F.col("failure") & (count > 0)).alias("mode_without_failure"))


@query(f"WITH {MODES}, a AS ({AUDIT_SQL}), u AS (UNPIVOT a ON COLUMNS(*) INTO NAME name VALUE observed) SELECT name, observed, e.expected, 'expected ' || e.expected || ', found ' || observed AS message FROM u JOIN (SELECT 'row_count' AS name, count(*) AS expected FROM lineitem UNION ALL SELECT 'failures', sum((l_linestatus = 'F')::int)::bigint FROM lineitem UNION ALL SELECT 'm4', 0::bigint) e USING (name) WHERE observed IS DISTINCT FROM e.expected")
def j_expect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed counts against expected ones; only mismatches are returned."""
    seen = a_labels(spark, sf_dir)
    seen = seen.unpivot([], seen.columns, "name", "observed")
    lines = table(spark, sf_dir, "lineitem")
    want = lines.agg(F.count("*").alias("row_count"), total(F.col("l_linestatus") == "F").alias("failures"), F.lit(0).cast("long").alias("m4"))
    want = want.unpivot([], want.columns, "name", "expected")
    both = seen.join(want, "name").where(~F.col("observed").eqNullSafe(F.col("expected")))
    return both.withColumn("message", F.concat(F.lit("expected "), F.col("expected").cast("string"), F.lit(", found "), F.col("observed").cast("string")))


PROJECTS = "projects AS (SELECT n_name AS project, o_orderkey, o_orderdate, o_orderstatus = 'F' AS buggy FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey)"


@query(f"WITH {PROJECTS} SELECT project, count(o_orderkey) AS n, coalesce(sum(buggy::int), 0)::bigint AS positives, coalesce(sum(buggy::int) / nullif(count(o_orderkey), 0)::double, 0) AS yield FROM projects GROUP BY project")
def a_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives per project; projects without rows stay."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").cast("long").alias("p"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    per = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("p").alias("positives"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("project")).join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return nations.select("project", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("positives", F.lit(0)).alias("positives"), F.coalesce(F.try_divide("positives", "n"), F.lit(0.0)).alias("yield"))


@query("SELECT year(o_orderdate)::int AS year, count(*) AS n, sum((o_orderstatus = 'F')::int)::bigint AS positives, avg((o_orderstatus = 'F')::int) AS yield FROM orders GROUP BY 1")
def a_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), total(p).alias("positives"), F.avg(p.cast("int")).alias("yield"))


@query("""WITH u AS (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS life FROM lineitem GROUP BY 1)
 SELECT sum(n)::bigint AS row_count, count(*) AS units, min(life)::int AS shortest, quantile_cont(life, 0.25) AS q1, quantile_cont(life, 0.5) AS median, quantile_cont(life, 0.75) AS q3, max(life)::int AS longest, round(avg(life), 6) AS mean FROM u""")
def a_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, units and the distribution of their lives."""
    u = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("life"))
    q = lambda p, n: F.percentile("life", F.lit(p)).alias(n)
    return u.agg(F.sum("n").alias("row_count"), F.count("*").alias("units"), F.min("life").alias("shortest"), q(0.25, "q1"), q(0.5, "median"), q(0.75, "q3"), F.max("life").alias("longest"), F.round(F.avg("life"), 6).alias("mean"))


GAPS = "gaps AS (SELECT date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap FROM events)"


def user_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return rows.select((F.unix_timestamp(F.date_trunc("second", F.col("ts")).cast("timestamp")) - F.unix_timestamp(F.date_trunc("second", before).cast("timestamp"))).alias("gap")).where("gap IS NOT NULL")


@query(f"WITH {GAPS}, h AS (SELECT gap, count(*) AS n FROM gaps WHERE gap IS NOT NULL GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY gap) AS upto, sum(n) OVER () AS every FROM h) SELECT gap, n, round(n / every, 9) AS share, upto > (every - 1) // 2 AND upto - n <= (every - 1) // 2 AS median_here, row_number() OVER (ORDER BY n DESC, gap) = 1 AS modal FROM c")
def a_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of the gaps in seconds between a resource's readings, with the weighted median (the lower one) and the
    most frequent gap, the shortest of several. The median comes from running sums over ranges of the gap."""
    h = user_gaps(spark, sf_dir).groupBy("gap").agg(F.count("*").alias("n"))
    all_ = h.agg(F.sum("n").alias("every"), F.max(F.struct("n", (-F.col("gap")).alias("shortest")))["shortest"].alias("shortest"))
    h = running(h.withColumn("at", F.col("gap") / (F.col("gap") + 600)), [], "at", ["n"]).join(F.broadcast(all_))
    middle = F.floor((F.col("every") - 1) / 2)
    return h.select("gap", "n", F.round(F.col("n") / F.col("every"), 9).alias("share"), ((F.col("n_before") <= middle) & (F.col("n_before") + F.col("n") > middle)).alias("median_here"), (F.col("gap") == -F.col("shortest")).alias("modal"))


@query("SELECT date_trunc('hour', ts) AS hour, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def a_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@query("SELECT date_trunc('minute', ts) AS minute, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def a_bin_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@query("SELECT user_id, round(avg(value), 6) AS mean, round(avg(value) - 1.96 * stddev_pop(value), 6) AS low, round(avg(value) + 1.96 * stddev_pop(value), 6) AS high FROM events GROUP BY user_id")
def a_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast of each resource with an interval of 1.96 deviations."""
    m, s = F.avg("value"), F.stddev_pop("value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(m, 6).alias("mean"), F.round(m - 1.96 * s, 6).alias("low"), F.round(m + 1.96 * s, 6).alias("high"))


@query("SELECT l_returnflag AS label, quantile_cont(l_extendedprice, 0) AS q0, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS q2, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, quantile_cont(l_extendedprice, 1) AS q4 FROM lineitem GROUP BY 1")
def a_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box-plot quantiles of a sensor by label."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), F.col("l_extendedprice").alias("v"))
    place = lambda p: (F.col("n") - 1) * F.lit(p)
    shares = {k: k / 4 for k in range(5)}
    found = at_ranks(rows, ["label"], "v", {f"{e}{k}": f(place(p)) for k, p in shares.items() for e, f in (("lo", F.floor), ("hi", F.ceil))})
    n = rows.where("v IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))
    part = lambda p: place(p) - F.floor(place(p))
    between = {k: F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * part(p) for k, p in shares.items()}
    return found.join(n, "label").select("label", *((F.round(c, 4) if 0 < k < 4 else c).alias(f"q{k}") for k, c in between.items()))


@query("SELECT count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_shipdate) AS days FROM lineitem")
def a_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_shipdate").alias("days"))


@query()
def a_distinct_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts within two percent, without a shuffle of the values."""
    n = lambda c: F.approx_count_distinct(c, 0.02)
    return table(spark, sf_dir, "lineitem").agg(n("l_orderkey").alias("orders"), n("l_partkey").alias("parts"), n("l_shipdate").alias("days"))


@query("SELECT count(*) AS inversions FROM (SELECT o_orderdate < lag(o_orderdate) OVER (ORDER BY o_orderkey) AS back FROM orders) WHERE back")
def w_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent timestamps that go back, in file order."""
    gaps = adjacent_gaps(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate")
    return gaps.where("o_orderdate < before").agg(F.count("*").alias("inversions"))


@query("SELECT bool_and(coalesce(ts >= before, true)) AS monotonic, count(*) FILTER (WHERE ts < before) AS errors FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS before FROM events)")
def w_mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.coalesce(F.col("ts") < F.col("before"), F.lit(False))
    return adjacent_gaps(table(spark, sf_dir, "events"), "event_id", "ts").agg(F.bool_and(~back).alias("monotonic"), total(back).alias("errors"))


LINES = "lines AS (SELECT l_orderkey AS unit, l_linenumber AS cycle, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS before FROM lineitem)"


@query(f"WITH {LINES} SELECT count(*) FILTER (WHERE cycle = before) AS repeats, count(*) FILTER (WHERE cycle > before + 1) AS gaps, count(*) FILTER (WHERE cycle < before) AS steps_back, count(*) FILTER (WHERE before IS NULL AND cycle <> 1) AS late_starts FROM lines")
def w_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's cycle must be the one before plus one."""
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("c"), F.lag("l_linenumber").over(w).alias("b"))
    c, b = F.col("c"), F.col("b")
    return rows.agg(total(c == b).alias("repeats"), total(c > b + 1).alias("gaps"), total(c < b).alias("steps_back"), total(b.isNull() & (c != 1)).alias("late_starts"))


@query("SELECT l_orderkey AS unit, l_linenumber AS cycle, (max(l_linenumber) OVER (PARTITION BY l_orderkey) - l_linenumber)::int AS rul FROM lineitem")
def w_rul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remaining life of each row: the unit's last cycle less its own."""
    last = F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("cycle"), (last - F.col("l_linenumber")).alias("rul"))


@query("SELECT unit, last_cycle::int AS last_cycle, n > 1 AS tied FROM (SELECT l_orderkey AS unit, max(l_linenumber) AS last_cycle FROM lineitem GROUP BY 1) JOIN (SELECT l_orderkey AS unit, l_linenumber AS last_cycle, count(*) AS n FROM lineitem GROUP BY ALL) USING (unit, last_cycle)")
def w_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final row of each unit, and whether it is tied: one aggregation of counts per cycle, no window."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    last = per.groupBy(F.col("l_orderkey").alias("unit")).agg(F.max(F.struct("l_linenumber", "n")).alias("m"))
    return last.select("unit", F.col("m.l_linenumber").alias("last_cycle"), (F.col("m.n") > 1).alias("tied"))


@query("SELECT user_id, min(ts) AS first_ts, min_by(value, struct_pack(a := ts, b := value)) AS value FROM events GROUP BY user_id")
def w_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first observation of each job, ties by value."""
    first = F.min(F.struct("ts", "value"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(first.alias("f")).select("user_id", F.col("f.ts").alias("first_ts"), F.col("f.value").alias("value"))


@query("SELECT l_orderkey, l_linenumber, count(*) - 1 AS repeats FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def w_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that occur again, and how often."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.count("*") - 1).alias("repeats")).where("repeats > 0")


@query("SELECT event_id, ts, user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-08'")
def flt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a type between two instants, both included."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    rows = table(spark, sf_dir, "events").where((F.col("event_type") == "error") & F.col("ts").between(at("2024-01-05"), at("2024-01-08")))
    return rows.select("event_id", "ts", "user_id").orderBy("ts", "event_id")


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id")
def k_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts").orderBy("ts", "event_id")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def flt_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    rows = table(spark, sf_dir, "orders").where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderdate") >= at("1996-01-01")) & (F.col("o_orderdate") < at("1997-01-01")))
    return rows.select("o_orderkey", "o_orderdate")


@query("SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM events GROUP BY user_id HAVING min(ts) >= TIMESTAMP '2024-01-01' AND min(ts) < TIMESTAMP '2024-01-01 12:00:00' AND count(*) >= 2")
def flt_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose first time lies in the declared range, with two observations or more."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))
    return per.where((F.col("first_ts") >= at("2024-01-01")) & (F.col("first_ts") < at("2024-01-01 12:00:00")) & (F.col("n") >= 2))


@query("SELECT o_orderkey, rn <= floor(0.7 * n) AS train FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)")
def k_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first seven tenths by time train."""
    return split_at_fraction(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 0.7).select("o_orderkey", "train")


@query("SELECT event_id, rn <= greatest(1, least(n - 1, floor(0.6 * n))) AS train FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn, count(*) OVER () AS n FROM events)")
def k_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered holdout on a unique key; both sides keep a row."""
    return split_at_fraction(table(spark, sf_dir, "events").select("event_id"), "event_id", "event_id", 0.6, both=True).select("event_id", "train")


@query("SELECT event_id, ts < TIMESTAMP '2024-01-20' AS train FROM events")
def k_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")).alias("train"))
