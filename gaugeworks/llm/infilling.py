"""Fill-in-middle transformation by displacement scatter: texts are cut in three and rearranged around marker strings.

A task treats the UTF-8 bytes of many documents as one array. It scans the cuts (code point counts to byte positions),
writes how far each segment moves at the segment's first byte of a difference array, and the running sum gives every
byte its output shift; one numpy scatter then builds all outputs. The way back scans an output for the markers, which
occur nowhere else in it, and gathers the segments' bytes by the inverse shifts. Sums run in blocks, so that beside the
texts themselves memory is bounded whatever a text's length.

Forms: plain is the text itself; psm is <P>prefix<S>suffix<M>middle; spm is <S>suffix<P>prefix<M>middle. Cuts and form
depend on the document's id and length alone, so that reruns agree.

Defined results: a null text is empty, and empty texts stay plain, as do texts that hold a marker. A null id is hashed as
an empty one. Repeated rows and equal texts are treated each by its own id; cuts that tie give an empty middle. Texts
of any length are cut whole; an empty table gives no row. Other columns stay; one named like a result is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = len(PREFIX)
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Order in which prefix (0), middle (1) and suffix (2) are written, and the markers before them.
ORDERS = {PSM: ((0, PREFIX), (2, SUFFIX), (1, MIDDLE)), SPM: ((2, SUFFIX), (0, PREFIX), (1, MIDDLE))}
BLOCK = 1 << 20


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and where each begins (one more for the end)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def as_texts(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())


def scan_cuts(raw: np.ndarray, at: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """cuts (documents x k, in code points) as byte positions in raw."""
    blocks = np.arange(0, len(raw), BLOCK)
    first = lambda lo: (raw[lo : lo + BLOCK] & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum([np.count_nonzero(first(lo)) for lo in blocks])]).astype(np.int64)

    def ranked(position: np.ndarray) -> np.ndarray:
        """Code points that begin before these bytes, which ascend."""
        out, block = np.empty(len(position), np.int64), np.minimum(position // BLOCK, max(len(blocks) - 1, 0))
        for b in np.unique(block) if len(blocks) else ():
            here, run = block == b, np.concatenate([[0], np.cumsum(first(blocks[b]))])
            out[here] = before[b] + run[position[here] - blocks[b]]
        return out if len(blocks) else position * 0

    rank = (ranked(at[:-1])[:, None] + cuts).ravel()
    out, block = np.full(len(rank), len(raw), np.int64), np.searchsorted(before, rank, side="right") - 1
    for b in np.unique(block):
        if b < len(blocks):
            here = block == b
            out[here] = blocks[b] + np.flatnonzero(first(blocks[b]))[rank[here] - before[b]]
    return np.minimum(out.reshape(cuts.shape), at[1:, None])


def displaced(raw: np.ndarray, starts: np.ndarray, shifts: np.ndarray, out: np.ndarray, gather: bool = False) -> None:
    """Copy raw into out, every byte moved by the shift of the last start at or before it; gather: read from there instead."""
    size = len(out) if gather else len(raw)
    steps = np.diff(shifts, prepend=0)
    for lo in range(0, size, BLOCK):
        hi = min(size, lo + BLOCK)
        a, b = np.searchsorted(starts, [lo, hi])
        moves = np.zeros(hi - lo, np.int64)
        np.add.at(moves, starts[a:b] - lo, steps[a:b])
        moves[0] += shifts[a - 1] if a else 0
        there = np.arange(lo, hi) + np.cumsum(moves)
        if gather:
            out[lo:hi] = raw[there]
        else:
            out[there] = raw[lo:hi]


def build(texts: pa.Array, forms: np.ndarray, first: np.ndarray, second: np.ndarray) -> pa.Array:
    """The outputs of all texts, from their forms and their cuts in code points."""
    raw, at = as_bytes(texts)
    cuts = scan_cuts(raw, at, np.stack([first, second], axis=1).astype(np.int64))
    bounds = np.concatenate([at[:-1, None], cuts, at[1:, None]], axis=1)
    moved = forms != PLAIN
    size = np.diff(at) + 3 * MARK * moved
    to = np.concatenate([[0], np.cumsum(size)])
    shift = np.repeat((to[:-1] - at[:-1])[:, None], 3, axis=1)
    out = np.empty(to[-1], np.uint8)
    for form, order in ORDERS.items():
        rows = np.flatnonzero(forms == form)
        place = to[rows]
        for segment, mark in order:
            for k, byte in enumerate(mark):
                out[place + k] = byte
            place = place + MARK
            shift[rows, segment] = place - bounds[rows, segment]
            place = place + bounds[rows, segment + 1] - bounds[rows, segment]
    displaced(raw, bounds[:, :3].ravel(), shift.ravel(), out)
    return as_texts(out, to)


def marker_places(raw: np.ndarray, at: np.ndarray, rows: np.ndarray, mark: bytes) -> np.ndarray:
    """Where the marker stands in each of these documents; each holds it once."""
    found = []
    for lo in range(0, len(raw), BLOCK):
        x = raw[lo : lo + BLOCK + MARK - 1]
        n = len(x) - MARK + 1
        if n > 0:
            found.append(lo + np.flatnonzero((x[:n] == mark[0]) & (x[1 : n + 1] == mark[1]) & (x[2 : n + 2] == mark[2])))
    found = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
    return found[np.searchsorted(found, at[rows])] if len(rows) else np.zeros(0, np.int64)


def rebuild(outputs: pa.Array, forms: np.ndarray) -> pa.Array:
    """The texts again, from outputs and forms alone."""
    raw, at = as_bytes(outputs)
    size = np.diff(at) - 3 * MARK * (forms != PLAIN)
    to = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(at[:-1, None], 3, axis=1)  # where each segment's bytes stand in the output
    length = np.stack([size, size * 0, size * 0], axis=1)
    for form, order in ORDERS.items():
        rows = np.flatnonzero(forms == form)
        places = [marker_places(raw, at, rows, mark) for _, mark in order]
        for (segment, _), begin, end in zip(order, places, [*places[1:], at[rows + 1]], strict=True):
            source[rows, segment] = begin + MARK
            length[rows, segment] = end - begin - MARK
    begins = to[:-1, None] + np.cumsum(length, axis=1) - length
    out = np.empty(to[-1], np.uint8)
    displaced(raw, begins.ravel(), (source - begins).ravel(), out, gather=True)
    return as_texts(out, to)


@F.arrow_udf(StringType())
def _build(text: pa.Array, form: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    return build(text, form.to_numpy(zero_copy_only=False), first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False))


@F.arrow_udf(StringType())
def _rebuild(output: pa.Array, form: pa.Array) -> pa.Array:
    return rebuild(output, form.to_numpy(zero_copy_only=False))


def _part(digest: Column, k: int) -> Column:
    """The k-th group of 8 hex digits as a number, from 1."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 1, share: int = 90, spm: int = 20) -> DataFrame:
    """Adds n, form, prefix_chars, middle_chars and output. Of 100 documents about `share` are cut, of these `spm` in 100 suffix first."""
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    # Names of their own while the columns are made: df may hold columns that are called like the results.
    whole = F.coalesce(F.col("_row")[text], F.lit(""))
    out = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")).withColumn("_text", whole)
    out = out.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_row")[id_col].cast("string"), F.lit(""))), 256)).withColumn("_n", F.char_length("_text").cast("long"))
    held = [F.contains("_text", F.lit(m.decode())) for m in (PREFIX, SUFFIX, MIDDLE)]
    plain = (F.col("_n") == 0) | held[0] | held[1] | held[2] | (_part(F.col("_h"), 3) % 100 >= share)
    ends = [_part(F.col("_h"), k) % (F.col("_n") + 1) for k in (1, 2)]
    out = out.withColumn("_form", F.when(plain, PLAIN).when(_part(F.col("_h"), 4) % 100 < spm, SPM).otherwise(PSM))
    out = out.withColumn("_first", F.least(*ends)).withColumn("_second", F.greatest(*ends))
    chars = lambda c: F.when(F.col("_form") != PLAIN, c)
    new = [F.col("_n").alias("n"), F.col("_form").alias("form"), chars(F.col("_first")).alias("prefix_chars"), chars(F.col("_second") - F.col("_first")).alias("middle_chars")]
    return out.select(*(F.col("_row")[c].alias(c) for c in df.columns if c not in made), *new, _build("_text", "_form", "_first", "_second").alias("output"))


def restore(df: DataFrame, output: str = "output", form: str = "form", to: str = "restored") -> DataFrame:
    """Adds the exact text again, read from output and form."""
    return df.withColumn(to, _rebuild(F.col(output), F.col(form)))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restore(fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
