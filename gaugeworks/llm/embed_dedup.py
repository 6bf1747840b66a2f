"""Embedding near-dedup: spherical k-means cells, blocked cosine products in cells, one representative for each group.

1. Equal vectors become one point that counts as often as it occurs, so copies are never compared with each other.
2. Spherical k-means with sqrt(n) / SPREAD cells for n points is fitted on about SAMPLE points, chosen by a hash of the
   vector; every point is assigned.
3. Two unit vectors with cosine >= t are at most w = sqrt(2 - 2 t) apart. If y lives in cell c, then y (c - c') >= 0
   for any other centre c', so a linked x has x (c - c') >= -w |c - c'|. A point therefore visits exactly the cells
   whose boundary lies within w of it: no link is lost, whatever the cells look like. The recall is 1.
4. The residents of a cell are split into blocks of about BLOCK rows by a hash, and the cell's visitors and residents
   meet every block as one matrix product. A block counts each resident's links and joins points by union-find; it
   emits a row a resident and a forest of links, never pairs.

Vectors of different dimensions never link. Defined results: null vectors, zero vectors and vectors with null or
non-finite components have no links and stand for themselves; repeated rows are linked copies; an id that is null gets
a row too and names a component only if it is alone; a cosine that ties with the threshold links; an empty table gives
an empty result. Columns other than the id and the vector are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialize, table

THRESHOLD = 0.95
#: The fit's sample, the most cells, and the rows of a block. n points have sqrt(n) / SPREAD cells.
SAMPLE, CELLS, BLOCK, SPREAD = 20_000, 1024, 8192, 16
ROUNDS = 8
#: Visitors that meet a block in one matrix product.
PANEL = 256


def unit_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) -> (vec_id, key, dim, unit): the vector's digest and its direction in double precision."""
    for b in batches:
        ids, keys, dims, units = b.column(0), [], [], []
        for v in b.column(1).to_pylist():
            x = np.array(v, dtype=np.float64) if v and None not in v else np.zeros(0)
            if x.size and np.isfinite(x).all() and x.any():
                x = x + 0.0
                key = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                x = np.ldexp(x, -np.frexp(np.abs(x).max())[1])  # exact, and its squares neither overflow nor vanish
                keys.append(key), dims.append(len(x)), units.append((x / np.sqrt(x @ x)).tobytes())
            else:
                keys.append(None), dims.append(None), units.append(None)
        yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], ["vec_id", "key", "dim", "unit"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centres of the rows of x, which must be unit vectors; starts from evenly spaced rows."""
    centres = x[np.arange(k) * len(x) // k].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        centres[size > 1e-12] = total[size > 1e-12] / size[size > 1e-12, None]
    return centres


def cells_for(n: int) -> int:
    return max(1, min(CELLS, math.ceil(math.sqrt(n) / SPREAD)))


def fit_cells(points: DataFrame, sample: int = SAMPLE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension, the centres and the distances between them; dimensions with a single cell are left out.

    Per dimension a share of the points, by a hash, comes to the driver: `sample` of them, give or take their root."""
    sizes = {r["dim"]: r["count"] for r in points.groupBy("dim").count().where(F.col("count") > SPREAD * SPREAD).collect()}
    if not sizes:
        return {}
    share = F.create_map(*(F.lit(v) for d, n in sizes.items() for v in (d, min(1.0, sample / n))))
    chosen = points.where(F.col("dim").isin(*sizes)).where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share[F.col("dim")] * (1 << 30))
    drawn: dict[int, list] = {}
    for r in chosen.select("dim", "key", "unit").collect():
        drawn.setdefault(r["dim"], []).append((r["key"], r["unit"]))
    out = {}
    for d, rows in drawn.items():
        centres = spherical_kmeans(np.stack([np.frombuffer(u) for _, u in sorted(rows)]), min(len(rows), cells_for(sizes[d])))
        square = (centres * centres).sum(axis=1)
        out[d] = centres, np.sqrt(np.maximum(0.0, square[:, None] + square[None] - 2 * centres @ centres.T))
    return out


def assign(sent, width: float):
    """(dim, point, copies, unit) -> the same with each cell that a point visits. A dimension without centres is one cell."""
    kind = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("home", pa.bool_()), ("point", pa.int64()), ("copies", pa.int64()), ("unit", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sent.value
        for b in batches:
            dims, points, copies, units = (b.column(i).to_pylist() for i in range(4))
            rows = []
            for d in sorted(set(dims)):
                centres, gaps = cells.get(d, (np.zeros((1, d)), np.zeros((1, 1))))
                for i in (i for i, x in enumerate(dims) if x == d):
                    s = centres @ np.frombuffer(units[i])
                    home = int(np.argmax(s))
                    for c in np.flatnonzero(s - s[home] >= -width * gaps[home] - 1e-9):
                        rows.append((d, int(c), int(c) == home, points[i], copies[i], units[i]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kind)], schema=kind)

    return run


RESULT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


class CellBlock:
    """The residents of one block, and what its visitors have told about them."""

    def __init__(self, points: list[int], units: list[bytes], threshold: float):
        self.points, self.x = np.array(points), np.stack([np.frombuffer(u) for u in units])
        self.links, self.threshold = np.zeros(len(points), np.int64), threshold
        self.label = np.arange(len(points))
        self.touched = np.zeros(len(points), bool)
        self.edges: list[tuple[int, int]] = []

    def meet(self, points: np.ndarray, copies: np.ndarray, units: list[bytes]) -> None:
        near = np.stack([np.frombuffer(u) for u in units]) @ self.x.T >= self.threshold
        near &= points[:, None] != self.points[None]
        hits = np.flatnonzero(near.any(axis=1))
        self.links += near[hits].T @ copies[hits]
        for i in hits:
            told = np.unique(self.label[near[i]])
            low = told[0]
            if len(told) > 1:
                self.label[np.isin(self.label, told)] = low
            self.touched |= near[i]
            self.edges.append((int(points[i]), int(self.points[low])))

    def results(self):
        """(a, b, None) for links between points, (a, None, n) for a resident's links."""
        seen = [(int(p), int(self.points[k]), None) for p, k, t in zip(self.points, self.label, self.touched, strict=True) if t and p != self.points[k]]
        return [*((a, b, None) for a, b in self.edges), *seen, *((int(p), None, int(n)) for p, n in zip(self.points, self.links, strict=True))]


def blocks(threshold: float):
    """Rows (dim, cell, block, visits, point, copies, unit), a block's residents first -> RESULT rows."""

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(RESULT)], schema=RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, residents, block, panel = None, [], None, []

        def flush() -> None:
            if panel:
                block.meet(np.array([r[0] for r in panel]), np.array([r[1] for r in panel]), [r[2] for r in panel])
                panel.clear()

        for b in batches:
            for *k, visits, point, copies, unit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    if block:
                        flush()
                        yield out(block.results())
                    key, residents, block = k, [], None
                if not visits:
                    residents.append((point, unit))
                    continue
                if block is None and residents:
                    block = CellBlock([r[0] for r in residents], [r[1] for r in residents], threshold)
                if block:
                    panel.append((point, copies, unit))
                    if len(panel) >= PANEL:
                        flush()
        if block:
            flush()
            yield out(block.results())

    return run


def near_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of df."""
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    every = materialize(rows.mapInArrow(unit_vectors, "vec_id long, key binary, dim int, unit binary"), "units")
    points = every.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.max("dim").alias("dim"), F.max("unit").alias("unit"))
    # Inside the join a point is named by its row in the written table: ids may be null or repeat.
    points = materialize(points.withColumn("point", F.monotonically_increasing_id()), "points")
    sent = spark.sparkContext.broadcast(fit_cells(points))
    width = math.sqrt(max(0.0, 2 - 2 * threshold))
    placed = materialize(points.select("dim", "point", "copies", "unit").mapInArrow(assign(sent, width), "dim int, cell int, home boolean, point long, copies long, unit binary"), "cells")
    sizes = materialize(placed.where("home").groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    placed = placed.join(sizes, ["dim", "cell"])
    residents = placed.where("home").withColumn("block", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int")).withColumn("visits", F.lit(False))
    visitors = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("visits", F.lit(True))
    met = residents.unionByName(visitors).select("dim", "cell", "block", "visits", "point", "copies", "unit")
    met = met.repartition("dim", "cell", "block").sortWithinPartitions("dim", "cell", "block", "visits", "point")
    found = materialize(met.mapInArrow(blocks(threshold), "a long, b long, links long"), "found")
    groups = materialize(connected_components(found.where("b IS NOT NULL").select("a", "b")), "groups")
    lowest = points.select("point", "low").join(groups.selectExpr("node AS point", "component"), "point").groupBy("component").agg(F.min("low").alias("least"))
    least = groups.join(materialize(lowest, "lowest"), "component").selectExpr("node AS point", "least")
    counted = found.where("b IS NULL").selectExpr("a AS point", "links")
    named = points.join(counted, "point", "left").join(least, "point", "left")
    named = materialize(named.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "low").alias("component_id")), "named")
    done = every.select("vec_id", "key").join(named, "key", "left")
    done = done.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", F.when(F.col("key").isNull(), F.col("vec_id"))).alias("component_id"))
    return done.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
