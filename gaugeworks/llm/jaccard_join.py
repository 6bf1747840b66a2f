"""N-gram Jaccard join in the metric space of word-shingle sets: exact groups of documents at or above 0.8.

d(x, y) = 1 - |x n y| / |x u y| is a metric. Two sets are linked when d <= 0.2, which is the same as
9 |x - y| <= |x| + |y| for the symmetric difference. Equal sets are one point; the join runs on points.

1. Regions. Unrelated documents lie at distance 1 from each other, and from every document that could be a pivot, so
   document pivots alone would put every boundary window around everything. The first pivots are therefore the
   singleton sets {s}: d(x, {s}) = 1 - 1/|x| if s is in x, else 1. A point is nearest to all its own shingles at once,
   and a global order (rarest first, by a count sketch of all documents) breaks the tie. A linked point differs in at
   most a fifth of its shingles, so the boundary window is the first |x| - ceil(0.8 |x|) + 1 of them: two linked
   points always meet in a region of that window. Rows go to their regions in one exchange; regions of one point end
   there, regions that hold the same points become one, and a region that the sketch calls hot is dealt in shares.
2. Pivots and balls. Each region takes as pivot the point that lies in the most regions, so that of many near copies the
   one with the fewest changes of its own is taken, and measures the others. A parity sketch (two bits or more a
   shingle) bounds |x - y| from below and drops nearly all pairs that are apart; the rest are compared exactly. Points
   in the pivot's ball (d <= 0.2) are linked to it and need not be compared with each other, so a region of copies
   costs one comparison a copy.
3. Windows. A point o outside the ball can be linked to a point b in it only if d(b, pivot) >= d(o, pivot) - 0.2: the
   points of the ball in that window are replicated to the outer region, which is joined the same way, with its own
   pivot. The recursion ends for a region that is empty or holds one group, and for one that its pivot did not halve:
   there points are too far from each other for balls to help. So there are at most log2 of the largest region levels.
4. Leaves. Such a region is split into blocks; every point outside the region's group meets every block, first by
   sketch, and those with any partner left exactly, linking groups by union-find. No pair is ever emitted more than
   once for each point and group, and nothing is dropped.

The count sketch has a fixed size. What it must tell apart are shingles that make large regions: with N shingles in all
a counter holds N / COUNTERS by chance, give or take the square root of that, and a shingle of more documents than a
few of these roots stands out at any N. Shingles are 64-bit polynomial hashes; points are 128-bit hashes of sets.

Defined results: words are split at blank and \\x09-\\x0D and lower-cased from A to Z; a text of one to four words is one
shingle; an empty or null text has no shingles and its own id as component; repeated rows are copies of each other; a
null id takes part but is never a component's name unless it is alone; an empty table gives no rows. Columns other than
the id and the text are not read, so their names can't clash. Texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize, table

WORDS = 5
#: Counters of the sketch that orders shingles by how common they are, and into how many blocks it is cut.
COUNTERS, PARTS = 1 << 21, 16
#: Bits of the filter that says which points' sets are wanted: 16 for each, within these bounds.
FILTER_BITS = (1 << 16, 1 << 27)
#: Points of a region that one task holds at a time, and points of a share of a hot region.
BLOCK = 1024
SEEN_POINTS = 500_000
#: So many pairs of points (32 bytes each) at most are sent to all executors, so that only their own sets are exchanged.
FEW_PAIRS = 100_000


class Powers:
    """Powers of an odd factor and of its inverse modulo 2^64, as many as the longest text so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            more = 1 << int(n - 1).bit_length()
            each = np.full(more, FACTOR, np.uint64)
            each[0] = 1
            self.up = np.multiply.accumulate(each)
            each[1:] = np.uint64(pow(int(FACTOR), -1, 1 << 64))
            self.down = np.multiply.accumulate(each)
        return self.up[:n], self.down[:n]


FACTOR = np.uint64(0x9E3779B97F4A7C15)
LETTER = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_powers = Powers()


def stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text: polynomial hashes of five words with single blanks between them,
    taken as differences of one running sum over the text's bytes."""
    plain = b" ".join(text.encode().lower().split()) if text else b""
    if not plain:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(plain, np.uint8)
    up, down = _powers.upto(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(LETTER[raw] * up[:-1], out=total[1:])
    blanks = np.flatnonzero(raw == 32)
    if len(blanks) < WORDS - 1:
        begin, end = np.zeros(1, np.int64), np.array([len(raw)])
    else:
        begin = np.concatenate([np.zeros(1, np.int64), blanks[: len(blanks) - WORDS + 1] + 1])
        end = np.concatenate([blanks[WORDS - 1 :], np.array([len(raw)])])
    found = stirred((total[end] - total[begin]) * down[begin])
    found.sort()
    return found[np.concatenate([np.ones(1, bool), found[1:] != found[:-1]])]


def point_of(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def handle_of(point: bytes) -> int:
    """The first half of a point, which stands for it in the exchange into regions."""
    return int.from_bytes(point[:8], "little", signed=True)


def parity(s: np.ndarray) -> bytes:
    """One bit for each of at least 2 |s| cells: whether an odd number of shingles falls there."""
    cells = 1 << max(6, int(2 * len(s) - 1).bit_length())
    odd = np.bincount((s >> np.uint64(7)).astype(np.int64) & (cells - 1), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The sketch (last axis: bytes) with fewer cells."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def difference(x: np.ndarray, y: np.ndarray) -> int:
    """The size of the symmetric difference of the sorted sets x and y."""
    merged = np.concatenate([x, y])
    merged.sort()
    return len(merged) - 2 * int(np.count_nonzero(merged[1:] == merged[:-1]))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether 100 |x n y| >= 80 |x u y|."""
    return 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 9 * difference(x, y) <= len(x) + len(y)


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


FIRST = pa.schema([("doc_id", pa.int64()), ("point", pa.binary()), ("handle", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])
FIRST_SQL = "doc_id long, point binary, handle long, n long, bits binary, part int, counts binary"


def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> a row for each document, then the task's part of the count sketch in PARTS rows."""
    counts, rows, cells, held = np.zeros(COUNTERS, np.int64), [], [], 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            s = shingles(text)
            cells.append((s & np.uint64(COUNTERS - 1)).astype(np.int64))
            held += len(s)
            if held > COUNTERS:
                counts += np.bincount(np.concatenate(cells), minlength=COUNTERS)
                cells, held = [], 0
            p = point_of(s) if len(s) else None
            rows.append((doc, p, handle_of(p) if p else None, len(s), parity(s) if p else None, None, None))
        yield batch(FIRST, rows)
        rows = []
    if held:
        counts += np.bincount(np.concatenate(cells), minlength=COUNTERS)
    if counts.any():
        yield batch(FIRST, [(None, None, None, None, None, k, packed(c)) for k, c in enumerate(counts.reshape(PARTS, -1))])


def packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u4").tobytes(), 1)


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, counts) -> the same, added up over the task."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            c = np.frombuffer(zlib.decompress(counts.as_py()), "<u4").astype(np.int64)
            total[part] = total[part] + c if part in total else c
    kind = pa.schema([("part", pa.int32()), ("counts", pa.binary())])
    yield batch(kind, [(k, packed(np.minimum(c, 2**32 - 1))) for k, c in sorted(total.items())])


def count_sketch(first: DataFrame) -> np.ndarray:
    """How many documents hold a shingle of each counter: COUNTERS numbers, whatever the input's size."""
    part = "part int, counts binary"
    rows = first.where("part IS NOT NULL").select("part", "counts").mapInArrow(summed, part).repartition(PARTS, "part").mapInArrow(summed, part).collect()
    return np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(zlib.decompress(r["counts"]), "<u4") for r in sorted(rows, key=lambda r: r["part"]))])


def window(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles whose regions a point enters: the first in the global order, as many as links can miss plus one."""
    most = len(s) - -(-4 * len(s) // 5) + 1
    return s[np.lexsort((s, counts[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]))[:most]]


def enter_regions(sent):
    """text -> (region, share, handle). A region that more than BLOCK documents enter by the sketch is dealt in shares
    from 1 on; all others have share 0."""
    kind = pa.schema([("region", pa.int64()), ("share", pa.int32()), ("handle", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sent.value, set()
        by_chance = counts.mean() if len(counts) else 0.0
        for b in batches:
            regions, shares, handles = [], [], []
            for text in b.column(0).to_pylist():
                s = shingles(text)
                if not len(s) or (h := handle_of(point_of(s))) in seen:
                    continue
                if len(seen) < SEEN_POINTS:
                    seen.add(h)  # copies in the same task enter once
                w = window(s, counts)
                needs = np.ceil((counts[(w & np.uint64(COUNTERS - 1)).astype(np.int64)] - by_chance) / BLOCK)
                regions.append(w.view(np.int64))
                shares.append(np.where(needs > 1, 1 + h % np.maximum(needs, 1), 0).astype(np.int32))
                handles.append(np.full(len(w), h))
            if regions:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (regions, shares, handles)], schema=kind)

    return run


def best_point(where: Column | None = None) -> Column:
    """Aggregate: the most popular point, of those that tie the last."""
    each = F.struct("popular", "point")
    return F.max(each if where is None else F.when(where, each))["point"]


def form_regions(entered: DataFrame, classes: DataFrame) -> DataFrame:
    """(region, pivot, point, popular): the regions of more than one point, the pivot itself left out; popular is the number
    of a point's regions, and the pivot's is the largest.

    All rows are exchanged once. Regions of the same points get the same name, from their points' hashes. Two points of
    one handle both come out wherever either went in, which adds candidates; they would miss each other only if they
    were linked and shared 64 bits as well."""
    here = Window.partitionBy("region", "share")
    low, high, mark = F.min("handle").over(here), F.max("handle").over(here), F.bit_xor(F.xxhash64("handle")).over(here)
    held = entered.select("region", "share", "handle", low.alias("low"), high.alias("high"), mark.alias("mark")).where("share > 0 OR low <> high")
    held = held.select(F.when(F.col("share") > 0, F.col("region")).otherwise(F.xxhash64("low", "high", "mark")).alias("region"), "handle")
    held = materialize(held.distinct(), "held")
    popular = held.groupBy("handle").agg(F.count("*").alias("popular"))
    names = classes.select("handle", "point").join(popular, "handle")
    named = materialize(held.join(names, "handle").select("region", "point", "popular"), "named")
    pivots = named.groupBy("region").agg(best_point().alias("pivot"), F.count("*").alias("k")).where("k > 1").select("region", "pivot")
    members = materialize(named.join(pivots, "region").where("point <> pivot").select("region", "pivot", "point", "popular"), "members")
    discard(held)
    discard(named)
    return members


def wanted_filter(keys: DataFrame, bits: int) -> bytes:
    """A bit for each wanted (point, rep), modulo bits."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits, bool)
        for b in batches:
            for p, rep in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[filter_key(p, rep) & (bits - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(held).tobytes(), 1)], pa.binary())], ["bits"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for v in b.column(0):
                total |= np.frombuffer(zlib.decompress(v.as_py()), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["bits"])

    few = keys.select("point", "rep").mapInArrow(marked, "bits binary").repartition(8).mapInArrow(joined, "bits binary").collect()
    total = np.zeros(bits // 8, np.uint8)
    for r in few:
        total |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return total.tobytes()


def filter_key(point: bytes, rep: int | None) -> int:
    return int.from_bytes(point[:8], "little") ^ (rep or 0)


def sets_of(docs: DataFrame, points: DataFrame, classes: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(point, items): the shingle sets of the given points, each from the document that stands for it, beside those held.

    A filter keeps other documents' sets out of the shuffle; what it lets through by chance, the join drops."""
    points = points.distinct()
    if held is not None:
        points = points.join(held.select("point"), "point", "left_anti")
    wanted = materialize(classes.join(points, "point", "left_semi").select("point", "rep"), "wanted")
    if not (n := wanted.count()):
        discard(wanted)
        return held if held is not None else docs.sparkSession.createDataFrame([], "point binary, items binary")
    low, high = FILTER_BITS
    bits = min(high, max(low, 1 << (16 * n - 1).bit_length()))
    sent = docs.sparkSession.sparkContext.broadcast(wanted_filter(wanted, bits))
    kind = pa.schema([("point", pa.binary()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(text)
                if len(s):
                    k = filter_key(p := point_of(s), doc) & (bits - 1)
                    if asked[k >> 3] & (128 >> (k & 7)):
                        rows.append((p, s.tobytes()))
            yield batch(kind, rows)

    found = docs.mapInArrow(run, "point binary, items binary").join(wanted, "point", "left_semi")
    more = materialize(found.groupBy("point").agg(F.max("items").alias("items")), "sets")
    discard(wanted)
    return more if held is None else held.unionAll(more)


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of pairs (a, b) with their exact distance d and whether they are linked."""

    def exact(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([difference(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(a, b, strict=True)], pa.int64())

    few = pairs.count() <= FEW_PAIRS
    sent = F.broadcast if few else (lambda d: d)
    x = sets.selectExpr("point AS a", "items AS x").join(sent(pairs), "a")
    y = sets.selectExpr("point AS b", "items AS y")
    y = y.join(sent(pairs.select("b").distinct()), "b", "left_semi") if few else y
    both = x.join(y, "b")
    both = both.select("a", "b", ((F.length("x") + F.length("y")) / 8).alias("n"), F.arrow_udf(exact, "bigint")("x", "y").alias("apart"))
    return both.select("a", "b", (2 * F.col("apart") / (F.col("n") + F.col("apart"))).alias("d"), (9 * F.col("apart") <= F.col("n")).alias("linked"))


def bounds(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, far, near): each point a with each of its pivots b, a lower bound of d(a, b), and whether they may be linked."""
    of = lambda p: classes.selectExpr(f"point AS {p}", f"n AS n{p}", f"bits AS bits{p}")
    pairs = members.selectExpr("point AS a", "pivot AS b").distinct().join(of("a"), "a").join(of("b"), "b")
    total = F.col("na") + F.col("nb")

    def least(na: pa.Array, nb: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([max(abs(m - n), apart(x, y)) for m, n, x, y in zip(na.to_pylist(), nb.to_pylist(), a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())

    pairs = pairs.withColumn("_apart", F.arrow_udf(least, "bigint")("na", "nb", "bitsa", "bitsb"))
    return pairs.select("a", "b", (2 * F.col("_apart") / (total + F.col("_apart"))).alias("far"), (9 * F.col("_apart") <= total).alias("near"))


def ball_distances(near: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, d, linked) of near pairs. A point is compared with its least pivot first, and with others only if that leaves them apart."""
    if near.isEmpty():
        return materialize(near.selectExpr("a", "b", "0.0D AS d", "true AS linked"), "distances")
    pairs = materialize(near.groupBy("a").agg(F.min("b").alias("b")), "pairs")
    first = materialize(compare(pairs, sets), "first_pairs")
    root = lambda p: first.where("linked").selectExpr(f"a AS {p}", f"b AS r{p}")
    more = near.join(root("a"), "a", "left").join(root("b"), "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")
    more = materialize(more.join(first.select("a", "b"), ["a", "b"], "left_anti"), "more_pairs")
    out = first if more.isEmpty() else materialize(first.unionAll(compare(more, sets)), "distances")
    for t in (pairs, more, first) if out is not first else (pairs, more):
        discard(t)
    return out


def outer_regions(members: DataFrame, measured: DataFrame, distances: DataFrame, groups: DataFrame) -> DataFrame:
    """(region, pivot, point, popular, grp, outside, halved) for regions that still have more than one group: points outside the
    old pivot's group, and those of its ball that lie in a window of one of them; the new pivot is one of the outside.
    members: (region, pivot, point, popular), the pivot itself left out."""
    named = members.join(groups.selectExpr("node AS point", "component AS pg"), "point", "left").join(groups.selectExpr("node AS pivot", "component AS vg"), "pivot", "left")
    named = named.selectExpr("region", "point", "popular", "pivot", "coalesce(pg, point) AS grp", "coalesce(vg, pivot) AS of_pivot").withColumn("outside", F.expr("grp <> of_pivot"))
    named = named.join(measured.selectExpr("a AS point", "b AS pivot", "far"), ["point", "pivot"])
    exact = distances.selectExpr("a AS point", "b AS pivot", "d", "linked")
    named = named.join(exact, ["point", "pivot"], "left").selectExpr("region", "point", "popular", "grp", "outside", "coalesce(d, far) AS far", "CASE WHEN linked THEN d END AS d")
    named = materialize(named, "named")
    opened = named.groupBy("region").agg(F.min(F.when(F.col("outside"), F.col("far"))).alias("nearest"), F.count("*").alias("k")).where("nearest IS NOT NULL AND k > 1")
    kept = named.join(opened, "region").where(F.col("outside") | F.col("d").isNull() | (F.col("d") >= F.col("nearest") - 0.2 - 1e-9))
    kept = materialize(kept.select("region", "point", "popular", "grp", "outside", "k"), "kept")
    left = kept.groupBy("region").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), best_point(F.col("outside")).alias("pivot"), (2 * F.count("*") <= F.max("k") + 1).alias("halved"))
    out = materialize(kept.join(left.where("lo <> hi").select("region", "pivot", "halved"), "region").select("region", "pivot", "point", "popular", "grp", "outside", "halved"), "outer")
    for t in (named, kept):
        discard(t)
    return out


class Forest:
    """Union-find over group names."""

    def __init__(self):
        self.up: dict[bytes, bytes] = {}

    def root(self, x: bytes) -> bytes:
        while (u := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(u, u)
            x = u
        return x

    def join(self, a: bytes, b: bytes) -> None:
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def blocks_of(outer: DataFrame) -> DataFrame:
    """Deals each region's points over blocks of about BLOCK; points outside the pivot's group also visit every block."""
    sizes = materialize(outer.groupBy("region").agg(F.count("*").alias("k")).withColumn("blocks", F.ceil(F.col("k") / BLOCK).cast("int")).drop("k"), "sizes")
    placed = outer.join(sizes, "region")
    home = placed.withColumn("block", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int")).withColumn("visits", F.lit(False))
    visits = placed.where("outside").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("visits", F.lit(True))
    return home.unionByName(visits).select("region", "block", "visits", "point", "grp")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, block, visits, point, grp, n, bits), residents of a block first -> (region, point) with a partner that
    neither sizes nor sketches rule out. Residents are held, visitors pass by one at a time."""
    kind = pa.schema([("region", pa.int64()), ("point", pa.binary())])
    key, grp, n, bits, points, stacks, out = None, [], [], [], [], None, set()
    for region, block, visits, point, g, size, sketch in rows_of(batches):
        if (region, block) != key:
            key, grp, n, bits, points, stacks = (region, block), [], [], [], [], None
        if not visits:
            grp.append(g), n.append(size), bits.append(np.frombuffer(sketch, np.uint8)), points.append(point)
            continue
        if stacks is None:
            by_len: dict[int, list[int]] = {}
            for i, x in enumerate(bits):
                by_len.setdefault(len(x), []).append(i)
            stacks = [(np.array(idx), np.stack([bits[i] for i in idx])) for idx in by_len.values()]
            numbers = {g: i for i, g in enumerate(dict.fromkeys(grp))}
            grp_of, n_of = np.array([numbers[g] for g in grp]), np.array(n)
        mine = np.frombuffer(sketch, np.uint8)
        for idx, stack in stacks:
            fit = (grp_of[idx] != numbers.get(g, -1)) & (5 * np.minimum(n_of[idx], size) >= 4 * np.maximum(n_of[idx], size))
            if fit.any():
                width = min(len(mine), stack.shape[1])
                apart_by = np.bitwise_count(folded(stack[fit], width) ^ folded(mine, width)).sum(axis=1)
                for i in idx[fit][9 * apart_by <= n_of[idx[fit]] + size]:
                    out |= {(region, point), (region, points[i])}
        if len(out) > 50_000:
            yield batch(kind, sorted(out))
            out = set()
    yield batch(kind, sorted(out))


def by_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, block, visits, point, grp, items) -> links (a, b) that join groups, by exact comparison."""
    kind = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    key, residents, forest, out = None, [], Forest(), []
    for region, block, visits, point, g, items in rows_of(batches):
        if (region, block) != key:
            key, residents, forest = (region, block), [], Forest()
        s = np.frombuffer(items, np.uint64)
        if not visits:
            residents.append((point, g, s))
            continue
        for other, h, t in residents:
            if forest.root(g) != forest.root(h) and linked(s, t):
                forest.join(g, h)
                out.append((point, other))
    yield batch(kind, out)


def leaf_links(docs: DataFrame, leaves: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """leaves (region, point, grp, outside) -> links (a, b). After the sketches, regions that are left with the same
    points become one."""
    order = ["region", "block", "visits"]
    sketched = blocks_of(leaves).join(classes.select("point", "n", "bits"), "point").select(*order, "point", "grp", "n", "bits")
    left = sketched.repartition("region", "block").sortWithinPartitions(*order, "point").mapInArrow(by_sketch, "region long, point binary")
    left = materialize(left.distinct(), "left")
    names = left.groupBy("region").agg(F.min("point").alias("low"), F.max("point").alias("high"), F.bit_xor(F.xxhash64("point")).alias("mark"))
    left_of = left.join(names, "region").select(F.xxhash64("low", "high", "mark").alias("region"), "point").distinct()
    left_of = materialize(left_of.join(leaves.select("point", "grp").distinct(), "point").select("region", "point", "grp", F.lit(True).alias("outside")), "left_of")
    sets = sets_of(docs, left_of.select("point"), classes, sets)
    rows = blocks_of(left_of).join(sets, "point").select(*order, "point", "grp", "items")
    links = materialize(rows.repartition("region", "block").sortWithinPartitions(*order, "point").mapInArrow(by_items, "a binary, b binary"), "links")
    discard(left)
    discard(left_of)
    return links


def grown(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """The groups (node, component) after more links (a, b)."""
    edges = links if groups is None else groups.selectExpr("node AS a", "component AS b").unionAll(links)
    out = materialize(connected_components(edges), "groups")
    if groups is not None:
        discard(groups)
    return out


def similar_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of df."""
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    first = materialize(docs.mapInArrow(first_pass, FIRST_SQL), "first")
    every = first.where("part IS NULL").select("doc_id", "point", "n")
    classes = materialize(first.where("point IS NOT NULL").groupBy("point").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("bits").alias("bits"), F.max("handle").alias("handle")), "classes")
    sent = spark.sparkContext.broadcast(count_sketch(first))
    members = form_regions(docs.select("text").mapInArrow(enter_regions(sent), "region long, share int, handle long"), classes)
    met = members.select("point").unionAll(members.select("pivot")).distinct()
    candidates = materialize(classes.join(met, "point", "left_semi"), "candidates")
    groups = sets = None
    leaves, outers = [], []
    while True:
        measured = materialize(bounds(members, candidates), "measured")
        near = measured.where("near").select("a", "b")
        sets = sets_of(docs, near.selectExpr("a AS point").unionAll(near.selectExpr("b AS point")), candidates, sets)
        distances = ball_distances(near, sets)
        groups = grown(groups, distances.where("linked").select("a", "b"))
        outer = outer_regions(members, measured, distances, groups)
        for t in (members, measured, distances):
            discard(t)
        outers.append(outer)
        leaves.append(outer.where("NOT halved").withColumn("region", F.xxhash64("region", F.lit(len(leaves)))))
        members = materialize(outer.where("halved AND point <> pivot").select("region", "pivot", "point", "popular"), "members")
        if members.isEmpty():
            break
    rest = reduce(DataFrame.unionAll, leaves).select("region", "point", "outside")
    rest = materialize(rest.join(groups.selectExpr("node AS point", "component"), "point", "left").select("region", "point", F.coalesce("component", "point").alias("grp"), "outside"), "leaves")
    if not rest.isEmpty():
        groups = grown(groups, leaf_links(docs, rest, candidates, sets))
    for t in (*outers, members, rest, candidates):
        discard(t)
    named = groups.selectExpr("node AS point", "component").join(classes.select("point", "rep"), "point")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    grouped = groups.selectExpr("node AS point", "component").join(least, "component").select("point", "least")
    names = classes.select("point", "rep").join(grouped, "point", "left").select("point", F.coalesce("least", "rep").alias("component_id"))
    names = materialize(names, "names")
    for t in (groups, classes):
        discard(t)
    done = every.join(names, "point", "left")
    return done.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("point").isNull(), F.col("doc_id"))).alias("component_id"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))
