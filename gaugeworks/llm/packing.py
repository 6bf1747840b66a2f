"""Best-fit packing by exact-complement hashing: token pieces into as few sequences of a fixed capacity as it can.

Pieces are placed by a plan made from the histogram of their lengths alone: at most `capacity` numbers, whatever the
input's size. For the longest length left, the plan looks up single lengths, then pairs, then triples of lengths that
fill the gap exactly, and takes the combination as often as the counts allow; a length without such a combination is
packed best fit, the longest length that fits first. A rule of the plan says: ranks lo..hi of a length go to these
sequences and offsets. Spark then ranks each length's pieces and looks each rank up.

Each length is dealt over buckets by a hash of the piece and its row, rows are ranked in a bucket and offset by the
counts of the buckets before it, so a length that a third of all pieces share is still many small groups, and so are
repeated rows.

Defined results: null text is empty, and an empty text is one piece holding only the end id; repeated rows are
packed each; lengths that tie are ranked by id; an empty table gives no piece. Only documents longer than the capacity
are cut; their first piece is the short one. Other columns stay; those that have the name of a result are replaced.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

CAPACITY, END_ID = 1024, 2
BUCKET_ROWS = 2000
PIECES = "piece int, start long, length long, ids_crc32 long, ids binary"


@lru_cache(maxsize=2)
def encoding(ranks_path: str):
    """The vocabulary of the byte-level tokenizer, read as ranks: the same ids, about four times as fast."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def token_ids(text: str | None, ranks_path: str) -> np.ndarray:
    ids = encoding(ranks_path).encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids.astype("<u4"), np.uint32(END_ID)).astype("<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenize(df: DataFrame, text: str = "text", ranks_path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """df's columns but the text, once for each piece, with piece, start, length, ids_crc32 and ids (little-endian 32-bit).
    Columns of df with these names are replaced."""
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]))

    @F.arrow_udf(f"array<struct<{PIECES.replace(' ', ':').replace(',:', ',')}>>")
    def pieces(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            ids = token_ids(t.as_py(), ranks_path)
            raw = ids.tobytes()
            out.append([{"piece": k, "start": s, "length": n, "ids_crc32": zlib.crc32(raw[4 * s : 4 * (s + n)]), "ids": raw[4 * s : 4 * (s + n)] if keep_ids else None} for k, (s, n) in enumerate(cut(len(ids), capacity))])
        return pa.array(out, kind)

    made = {part.split()[0] for part in PIECES.split(", ")}
    keep = [f"`{c}`" for c in df.columns if c != text and c not in made]
    return df.select(*keep, F.explode(pieces(F.col(text))).alias("_p")).select(*keep, "_p.*")


class Lengths:
    """Available counts by length, with the lengths still there in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.n)

    def take(self, combo: tuple[int, ...]) -> int:
        """Use the combination as often as the counts allow; returns how often."""
        uses = {k: combo.count(k) for k in combo}
        times = min(self.n.get(k, 0) // u for k, u in uses.items())
        for k, u in uses.items() if times else ():
            self.n[k] -= u * times
            if not self.n[k]:
                del self.n[k], self.order[bisect_left(self.order, k)]
        return times

    def longest(self, most: int) -> int | None:
        """The longest length left that is at most `most`."""
        at = bisect_left(self.order, most + 1)
        return self.order[at - 1] if at else None


class Sums:
    """The single lengths and the pairs of lengths by their sum, the most unequal pair last. A triple is looked up as
    its longest length and the pair that completes it, so that its sums need no table of their own."""

    def __init__(self, left: Lengths, capacity: int):
        self.left, self.pairs = left, defaultdict(list)
        for i, b in enumerate(left.order):
            for c in left.order[: min(i, bisect_left(left.order, capacity - b + 1) - 1) + 1]:
                self.pairs[b + c].append((b, c))

    def there(self, combo: tuple[int, ...]) -> bool:
        return all(self.left.n.get(k, 0) >= combo.count(k) for k in combo)

    def pair(self, total: int, most: int, beside: tuple[int, ...]) -> tuple[int, int] | None:
        """A pair of this sum with no length above `most` that is there beside the lengths already taken."""
        found = self.pairs.get(total, [])
        while found and not self.there(found[-1]):
            found.pop()  # used up for good
        return next((p for p in reversed(found) if p[0] <= most and self.there((*beside, *p))), None)

    def filling(self, a: int, gap: int) -> tuple[int, ...] | None:
        """a and one, two or three lengths that fill the gap exactly. The longest of them is the one that best fit
        would take, so that short lengths are not used up where a long one fits."""
        if not gap:
            return (a,)
        if self.there((a, gap)):
            return a, gap
        k = self.left.longest(gap)
        if k is None or not self.there((a, k)):
            return None
        if self.there((a, k, gap - k)):
            return a, k, gap - k
        rest = self.pair(gap - k, k, (a, k))
        return (a, k, *rest) if rest else None


def best_fit(left: Lengths, capacity: int) -> tuple[int, ...]:
    """The longest length left, and again and again the longest one that fits beside it."""
    combo, gap = (), capacity
    while (k := left.longest(gap)) is not None:
        if left.n[k] <= combo.count(k):
            fits = [x for x in left.order if x <= gap and left.n[x] > combo.count(x)]
            if not fits:
                break
            k = fits[-1]
        combo, gap = (*combo, k), gap - k
    return combo


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths that share a sequence, number of such sequences), from the counts of the lengths: for the longest
    length left an exact filling as often as the counts allow, or best fit where there is none."""
    left = Lengths(counts)
    sums, out = Sums(left, capacity), []
    while left.n:
        a = left.order[-1]
        combo = sums.filling(a, capacity - a) or best_fit(left, capacity)
        out.append((combo, left.take(combo)))
    return out


def rules(planned: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan as rules by (length, first rank), sorted: sequences, uses in each sequence, and offset of the first use."""
    rows, rank, first = [], {}, 0
    for combo, times in planned:
        at = 0
        for k in sorted(set(combo), reverse=True):
            uses = combo.count(k)
            rows.append((k, rank.get(k, 0), first, uses, at))
            rank[k] = rank.get(k, 0) + uses * times
            at += k * uses
        first += times
    rows.sort()
    return {name: np.array([r[i] for r in rows], dtype=np.int64) for i, name in enumerate(("length", "rank", "first", "uses", "at"))}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with doc_id, piece, length, ids_crc32) -> the same rows with sequence_id and offset.

    The pieces are written with their bucket, as they are read for the histogram and again for the ranks. The histogram
    that comes to the driver has at most `capacity` rows. Columns named sequence_id and offset are replaced."""
    kept = [f"`{c}`" for c in pieces.columns if c not in ("sequence_id", "offset")]
    row = lambda name: F.col(f"row.{name}")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(1 << 40))
    dealt = materialize(pieces.select(F.struct(*kept).alias("row"), F.col("length").alias("n"), salt.alias("salt")), "dealt")
    counts = {r["n"]: r["count"] for r in dealt.groupBy("n").count().collect()}
    table_of = rules(plan(counts, capacity))
    buckets = max(1, -(-max(counts.values(), default=0) // BUCKET_ROWS))
    dealt = dealt.withColumn("bucket", F.col("salt") % buckets)
    per = dealt.groupBy("n", "bucket").agg(F.count("*").alias("size"))
    before = Window.partitionBy("n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("n", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("at", F.row_number().over(Window.partitionBy("n", "bucket").orderBy(row("doc_id"), row("piece"), row("ids_crc32"))))
    ranked = ranked.join(offsets, ["n", "bucket"]).select("row", "n", (F.col("before") + F.col("at") - 1).alias("rank"))

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        key = (table_of["length"] << 44) + table_of["rank"]
        at = np.searchsorted(key, (n << 44) + r, side="right") - 1
        k = r - table_of["rank"][at]
        uses = table_of["uses"][at]
        return pa.StructArray.from_arrays([pa.array(table_of["first"][at] + k // uses), pa.array(table_of["at"][at] + k % uses * n)], ["sequence_id", "offset"])

    return ranked.select("row", place("n", "rank").alias("placed")).select(*(row(c) for c in kept), "placed.*")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_ids=False).drop("ids"))
