"""Substring dedup with repeated-phrase automata: passages of `window` words that an earlier document holds too are removed.

Every window is anchored by the one of its phrases (PHRASE words) that hashes lowest, so equal windows have equal
anchors, wherever they stand. Neighbouring windows with the same anchor are a run.

1. Confirm. The anchors' own words are grouped over all documents: phrases that anchor runs of several documents recur,
   with the first document that has each, whether all its runs are word for word alike, and the buckets of documents to
   search for it.
2. Compile. Each bucket, some megabytes of text, gets the recurring phrases of its documents as Aho-Corasick
   automata of a bounded size.
3. Stream. Every document of the bucket runs through its automata, which locate every occurrence. Runs of a phrase that
   always stands among the same words are repeats in all documents but its first. Where a phrase stands among different
   words, its windows are looked up one by one: a window's first document by a map-side combined minimum.

No group is ever held: groups are minima of numbers, so that a phrase or window of any number of documents is combined
before it is exchanged. Windows that are told apart by hashes use 128 bits (the phrase's 64 and the window's 64).

Defined results: a null text has no words; texts shorter than a window, and empty ones, stay whole; a null id is
neither earlier nor later than another and loses nothing; rows that share an id are not earlier than each other, and
each is judged; repeats within one document alone stay. Very long texts are searched in segments of SEGMENT windows that
overlap by a window. An empty table gives no row. Only the id column is kept.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

WINDOW, PHRASE = 50, 8
SEGMENT = 1 << 17
#: Text of one bucket, and phrases of one automaton, in bytes.
BUCKET_BYTES, AUTOMATON_BYTES = 8 << 20, 2 << 20
#: Texts of a batch are laid side by side up to so many bytes.
LINE = 1 << 20

# Odd multipliers of the two rolling hashes; any odd numbers would do.
BYTE_STEP, WORD_STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


@lru_cache(maxsize=8)
def _powers(step: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """step**k and its inverse**k modulo 2**64 for k below 2**bits."""
    steps = [np.full(1 << bits, s, dtype=np.uint64) for s in (step, pow(step, -1, 1 << 64))]
    for s in steps:
        s[0] = 1
    return np.cumprod(steps[0], dtype=np.uint64), np.cumprod(steps[1], dtype=np.uint64)


def powers(step: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(int(step), max(16, int(n).bit_length()))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    return mixed((prefix[ends] - prefix[starts]) * inverse[starts])


class Words:
    """The words of some texts side by side, hashed; texts are lists of words joined by one blank each."""

    def __init__(self, texts: list[bytes], window: int):
        self.window, self.line = window, b" ".join(texts) + b" "
        raw = np.frombuffer(self.line, dtype=np.uint8)
        self.ends = np.flatnonzero(raw == 32)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        forth, back = powers(BYTE_STEP, len(raw))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * forth[: len(raw)], dtype=np.uint64)])
        self.hash = range_hashes(prefix, self.starts, self.ends, back)
        forth, back = powers(WORD_STEP, len(self.ends))
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * forth[: len(self.hash)], dtype=np.uint64)])
        self.back = back
        #: The first word of each text, and one more for the end.
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the words from each start up to each end."""
        return range_hashes(self.prefix, starts, ends, self.back)

    def runs(self) -> dict[str, np.ndarray]:
        """Runs of windows with one anchor: text, first window (a word's place), number of windows, place of the anchor."""
        n, w = len(self.starts), self.window
        span = w - PHRASE + 1
        if n < w:
            return {k: np.zeros(0, np.int64) for k in ("text", "at", "count", "anchor")}
        phrase = self.hashes(np.arange(n - PHRASE + 1), np.arange(PHRASE, n + 1))
        least, size = phrase, 1
        while 2 * size <= span:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        least = np.minimum(least[: n - w + 1], least[span - size :][: n - w + 1])
        windows = np.arange(n - w + 1)
        text = np.searchsorted(self.first, windows, side="right") - 1
        inside = windows + w <= self.first[text + 1]
        segment = (windows - self.first[text]) // SEGMENT
        new = np.ones(len(windows), bool)
        new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (segment[1:] != segment[:-1])
        at = np.flatnonzero(new & inside)
        edges = np.append(np.flatnonzero(new), len(windows))
        until = edges[np.searchsorted(edges, at, side="right")]
        until = np.minimum(until, self.first[text[at] + 1] - w + 1)
        anchor = at.copy()
        for k in range(0, len(at), 4096):
            rows = at[k : k + 4096]
            anchor[k : k + 4096] += np.argmax(phrase[rows[:, None] + np.arange(span)] == least[rows, None], axis=1)
        return {"text": text[at], "at": at, "count": until - at, "anchor": anchor}

    def phrases(self, anchor: np.ndarray) -> list[bytes]:
        lo, hi = self.starts[anchor].tolist(), self.ends[anchor + PHRASE - 1].tolist()
        return [self.line[a:b] for a, b in zip(lo, hi, strict=True)]


def in_lines(texts: list[bytes | None], window: int):
    """(indices, their Words) of the texts that have at least a window of words, some megabytes at a time."""
    rows, size = [], 0
    for i, t in enumerate(texts):
        if t is None or t.count(b" ") < window - 1:
            continue
        if rows and size + len(t) > LINE:
            yield rows, Words([texts[k] for k in rows], window)
            rows, size = [], 0
        rows.append(i)
        size += len(t)
    if rows:
        yield rows, Words([texts[k] for k in rows], window)


def joined(text: str | None) -> bytes:
    """The words of a text, joined by one blank."""
    return b" ".join((text or "").encode().split())


def anchored(window: int):
    """Rows (phrase, around, doc_id, bucket): a row a run, around being the hash of all words of the run."""

    def emit(batches):
        for batch in batches:
            ids, buckets = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "bucket"))
            for rows, words in in_lines([joined(t) for t in batch.column("text").to_pylist()], window):
                run = words.runs()
                around = words.hashes(run["at"], run["at"] + run["count"] + window - 1).view(np.int64)
                of = np.array(rows)[run["text"]]
                yield pa.RecordBatch.from_arrays([pa.array(words.phrases(run["anchor"]), pa.binary()), pa.array(around), pa.array(ids[of]), pa.array(buckets[of])], ["phrase", "around", "doc_id", "bucket"])

    return emit


def recurring_phrases(docs: DataFrame, window: int) -> DataFrame:
    """(bucket, phrase, owner, alike): phrases that anchor runs of several documents, for each bucket that has them."""
    runs = docs.where("doc_id IS NOT NULL").mapInArrow(anchored(window), "phrase binary, around long, doc_id long, bucket long")
    per = runs.groupBy("phrase").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), (F.min("around") == F.max("around")).alias("alike"), F.collect_set("bucket").alias("buckets"))
    return per.where("owner < last").select(F.explode("buckets").alias("bucket"), "phrase", "owner", "alike")


class Automata:
    """The recurring phrases of a bucket as automata of bounded size, with what is known of each phrase."""

    def __init__(self):
        self.done, self.now, self.size, self.owner, self.alike = [], None, 0, [], []

    def add(self, phrase: bytes, owner: int, alike: bool) -> None:
        import ahocorasick

        if self.now is None or self.size + len(phrase) > AUTOMATON_BYTES:
            self.compile()
            self.now, self.size = ahocorasick.Automaton(), 0
        # A blank on either side: only whole words match. One character a byte.
        self.now.add_word(f" {phrase.decode('latin-1')} ", len(self.owner))
        self.size += len(phrase)
        self.owner.append(owner)
        self.alike.append(alike)

    def compile(self) -> None:
        if self.now is not None:
            self.now.make_automaton()
            self.done.append(self.now)
            self.now = None

    def locate(self, words: Words) -> np.ndarray:
        """For each word the number of the recurring phrase that begins there, or -1."""
        out = np.full(len(words.starts), -1, np.int64)
        text = " " + words.line.decode("latin-1")
        for automaton in self.done:
            found = np.fromiter(automaton.iter(text), dtype=np.dtype((np.int64, 2)))
            # A match ends at a blank, one place further than in the line itself.
            last = np.searchsorted(words.ends, found[:, 0] - 1)
            out[last - PHRASE + 1] = found[:, 1]
        return out


def covered(n: int, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in the windows from each start on, counts at a time."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + counts + window - 1, -1)
    return np.cumsum(steps[:n]) > 0


RESULT = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]
FOUND = pa.schema([("doc_id", pa.int64()), *RESULT, ("gone", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("seeds", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("words", pa.binary())])
FOUND_DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, gone array<int>, starts array<int>, seeds array<long>, hashes array<long>, words binary"


def result(text: bytes, gone: np.ndarray | None, keep_text: bool) -> dict:
    n = text.count(b" ") + 1 if text else 0
    kept = text if gone is None or not gone.any() else b" ".join(compress(text.split(b" "), (~gone).tolist()))
    return {"n_words": n, "n_removed": int(gone.sum()) if gone is not None else 0, "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept_text": kept.decode() if keep_text else None}


def searched(window: int, keep_text: bool):
    """Sorted rows of some buckets, a bucket's phrases before its documents -> a row a document: done, or with the
    windows that must be looked up (starts, seeds, hashes), the windows that are gone already, and the words."""

    def one(words: Words, k: int, i: slice, run: dict, pattern: np.ndarray, automata: Automata, doc_id: int, text: bytes) -> dict:
        at, count, p = run["at"][i] - words.first[k], run["count"][i], pattern[i]
        hit = p >= 0
        at, count, p = at[hit], count[hit], p[hit]
        alike, later = automata.alike_of[p], automata.owner_of[p] < doc_id
        gone = alike & later
        ask = ~alike
        if not ask.any():
            return {"doc_id": doc_id} | result(text, covered(words.first[k + 1] - words.first[k], at[gone], count[gone], window) if gone.any() else None, keep_text)
        n, starts = count[ask], np.repeat(at[ask], count[ask])
        starts = starts + np.arange(len(starts)) - np.repeat(np.cumsum(n) - n, n)
        place = run["anchor"][i][hit][ask]
        seeds = np.repeat(words.hashes(place, place + PHRASE), n)
        hashes = words.hashes(starts + words.first[k], starts + words.first[k] + window)
        return {"doc_id": doc_id, "gone": np.stack([at[gone], count[gone]], axis=1).ravel().astype(np.int32), "starts": starts.astype(np.int32), "seeds": seeds.view(np.int64), "hashes": hashes.view(np.int64), "words": text}

    def search(batches):
        bucket, automata = None, Automata()
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in ("bucket", "doc_id", "alike", "phrase", "text")}
            waiting: list[int] = []
            for k in range(batch.num_rows + 1):
                end = k == batch.num_rows
                if end or columns["bucket"][k] != bucket:
                    yield from documents(columns, waiting, automata)
                    waiting = []
                    if end:
                        break
                    bucket, automata = columns["bucket"][k], Automata()
                if columns["phrase"][k] is not None:
                    automata.add(columns["phrase"][k], columns["doc_id"][k], columns["alike"][k])
                else:
                    waiting.append(k)

    def documents(columns: dict, waiting: list[int], automata: Automata):
        if not waiting:
            return
        automata.compile()
        automata.owner_of, automata.alike_of = np.array(automata.owner, np.int64), np.array(automata.alike, bool)
        texts, ids = [joined(columns["text"][k]) for k in waiting], [columns["doc_id"][k] for k in waiting]
        plain = [i for i, t in enumerate(texts) if ids[i] is None or t.count(b" ") < window - 1]
        yield pa.RecordBatch.from_pylist([{"doc_id": ids[i]} | result(texts[i], None, keep_text) for i in plain], FOUND)
        for i in plain:
            texts[i] = None
        for rows, words in in_lines(texts, window):
            run = words.runs()
            pattern = automata.locate(words)[run["anchor"]]
            edges = np.searchsorted(run["text"], np.arange(len(rows) + 1)).tolist()
            yield pa.RecordBatch.from_pylist([one(words, k, slice(edges[k], edges[k + 1]), run, pattern, automata, ids[i], texts[i]) for k, i in enumerate(rows)], FOUND)

    return search


def finished(window: int, keep_text: bool):
    def finish(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                gone, more = np.array(r["gone"], np.int64).reshape(-1, 2), np.array(r["hits"] or [], np.int64)
                starts, counts = np.concatenate([gone[:, 0], more]), np.concatenate([gone[:, 1], np.ones(len(more), np.int64)])
                out.append({"doc_id": r["doc_id"]} | result(r["words"], covered(r["words"].count(b" ") + 1, starts, counts, window), keep_text))
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), *RESULT]))

    return finish


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept_text), a row a document. keep_text=False leaves kept_text null."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    docs = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(buckets))).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(buckets))))

    null = lambda kind: F.lit(None).cast(kind)
    phrases = recurring_phrases(docs, window).select("bucket", F.col("owner").alias("doc_id"), "alike", "phrase", null("string").alias("text"))
    rows = phrases.unionByName(docs.select("bucket", "doc_id", null("boolean").alias("alike"), null("binary").alias("phrase"), "text"))
    # A bucket a partition: a hash of their numbers would put several into one.
    dealt = rows.repartitionById(int(buckets), F.col("bucket").cast("int")).sortWithinPartitions("bucket", F.col("phrase").isNull())
    found = materialize(dealt.mapInArrow(searched(window, keep_text), FOUND_DDL).withColumn("row", F.monotonically_increasing_id()), "found")

    asked = found.where("words IS NOT NULL")
    looked_up = asked.select("row", "doc_id", F.inline(F.arrays_zip("starts", "seeds", "hashes")))
    first = materialize(looked_up.groupBy("seeds", "hashes").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last"), "first")
    hits = looked_up.join(first, ["seeds", "hashes"]).where("doc_id > owner").groupBy("row").agg(F.collect_list("starts").alias("hits"))
    late = asked.select("row", "doc_id", "gone", "words").join(hits, "row", "left").select("doc_id", "gone", "words", "hits")
    names = [n for n, _ in RESULT]
    done = found.where("words IS NULL").select("doc_id", *names)
    out = done.unionAll(late.mapInArrow(finished(window, keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"))
    return out.select(F.col("doc_id").alias(id_col), *names)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept_text")
