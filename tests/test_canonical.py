"""Canonical JSON against a plain serialiser, strict CSV with line numbers, and Gaussian projections."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.canonical import canonical_json, identity
from gaugeworks.plans.scoring import projected, projection
from gaugeworks.sources.readers import read_csv


def plain_number(x):
    if x == 0:
        return "0"
    sign, digits, power = ("-" if x < 0 else ""), *(repr(abs(x)).lower().split("e") + ["0"])[:2]
    left, _, right = digits.partition(".")
    run = (left + right).lstrip("0")
    n = len(left) + int(power) - (len(left + right) - len(run))
    run = run.rstrip("0")
    if len(run) <= n <= 21:
        return sign + run + "0" * (n - len(run))
    if 0 < n <= 21:
        return f"{sign}{run[:n]}.{run[n:]}"
    if -6 < n <= 0:
        return f"{sign}0.{'0' * -n}{run}"
    return f"{sign}{run[0]}{'.' + run[1:] if run[1:] else ''}e{'+' if n > 0 else '-'}{abs(n - 1)}"


def plain(x):
    if isinstance(x, dict):
        return "{" + ",".join(f"{plain(k)}:{plain(x[k])}" for k in sorted(x, key=lambda k: k.encode("utf-16-be"))) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(plain, x)) + "]"
    return plain_number(x) if isinstance(x, float) else json.dumps(x, ensure_ascii=False)


def test_numbers(spark):
    rnd = random.Random(1)
    xs = [0.0, -0.0, 1.0, -1.5, 1e20, 1e21, 1.5e21, 123456789012345680000.0, 1e-6, 1e-7, 1.25e-7, 0.1, 100.0, 4.35, 5e-324, 1.7976931348623157e308, 2**53 * 1.0]
    xs += [rnd.choice([-1, 1]) * rnd.random() * 10 ** rnd.randint(-30, 30) for _ in range(500)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", canonical_json(F.col("x"), T.DoubleType()).alias("t")).collect()
    other = [(r["x"], r["t"]) for r in got if r["t"] != plain_number(r["x"])]
    # The last of as many digits may differ where two such numbers read back.
    assert len(other) <= 3 and all(float(t) == x and len(t) == len(plain_number(x)) for x, t in other)
    bad = spark.createDataFrame([(float("nan"),), (float("inf"),)], "x double").select(canonical_json(F.struct("x"), T.StructType([T.StructField("x", T.DoubleType())])).alias("t"))
    assert [r["t"] for r in bad.collect()] == [None, None]


def test_records(spark):
    kind = T.StructType().add("z", "string").add("", "long").add("𝄞", "boolean").add("a", T.ArrayType(T.StructType().add("q", "double").add("b", "string"))).add("m", T.MapType(T.StringType(), T.ArrayType(T.LongType())))
    rows = [
        ("é\u0000\u001f\"\\/\b\t\n\f\r\u007f𝄞", 2**53 + 1, True, [(1.5, None), None, (1e-9, "x")], {"": [1], "𝄞": [], "é": None, 'a"': [2, 3]}),
        (None, None, None, None, None),
        ("", 0, False, [], {}),
    ]
    want = [plain({"z": z, "": n, "𝄞": t, "a": a if a is None else [x if x is None else {"q": x[0], "b": x[1]} for x in a], "m": m}) for z, n, t, a, m in rows]
    df = spark.createDataFrame([(r,) for r in rows], T.StructType().add("r", kind))
    got = [tuple(r) for r in df.select(canonical_json(F.col("r"), kind), identity(F.col("r"), kind)).collect()]
    assert got == [(w, hashlib.sha256(w.encode()).hexdigest()) for w in want]
    assert spark.createDataFrame([], T.StructType().add("r", kind)).select(identity(F.col("r"), kind)).count() == 0


def test_csv_lines_across_splits_and_files(spark, tmp_path):
    for name, head, lines in (("a", "﻿key,v", 3000), ("b", "key,v", 3000), ("c", "v,key", 5)):
        (tmp_path / f"{name}.csv").write_text(head + "\r\n" + "".join(f"{k},{'oops' if k % 500 == 7 else k}{',x' if k % 700 == 9 else ''}\n" for k in range(lines)) + ("\n" if name == "b" else ""), encoding="utf-8")
    (tmp_path / "d.csv").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        rows = read_csv(spark, [str(tmp_path), str(tmp_path / "e.csv")], {"key": "bigint", "v": "double"})
        assert rows.where("_line IS NOT NULL").rdd.getNumPartitions() > 10
        got = {(r["_file"].rsplit("/", 1)[1], r["_line"]): r["_errors"] for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 3000 + 3001 + 5 + 2
    for name in "ab":
        for k in range(3000):
            want = ["wrong number of fields"] if k % 700 == 9 else ["v is not double"] if k % 500 == 7 else []
            assert got[f"{name}.csv", k + 2] == want
    assert got["b.csv", 3002] == ["wrong number of fields"] and got["c.csv", 2] == ["unexpected header"]
    assert got["d.csv", None] == ["the file is empty or can't be read"] and got["e.csv", None] == ["the file is missing"]


def test_projections(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, rnd.normal(size=24).tolist()) for i in range(20)] + [(30, None), (31, []), (32, [1.0, None]), (33, [float("nan"), 1.0]), (34, [1.0, 2.0, 3.0])]
    got = {r["i"]: [r[f"p{k}"] for k in range(8)] for r in projected(spark.createDataFrame(rows, "i long, v array<double>"), "v").collect()}
    for i, v in rows[:20] + rows[-1:]:
        assert got[i] == pytest.approx((np.array(projection(len(v), 8)) @ np.array(v)).tolist())
    assert all(got[i] == [None] * 8 for i in (30, 31, 32, 33))
    w = np.array(projection(400, 50)) * math.sqrt(400)
    assert abs(w.mean()) < 0.03 and abs(w.std() - 1) < 0.03 and abs((w**4).mean() - 3) < 0.2
