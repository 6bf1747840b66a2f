"""Language identification by rank-order profiles of character n-grams.

A profile is a language's PROFILE most frequent n-grams (one to three characters, words padded with a blank) in
order. A document's own most frequent n-grams are ranked the same way, and each profile's distance is the sum of how
far each n-gram is out of place, PROFILE for one that the profile lacks. The nearest profile wins, the first by name
on a tie; the score is 1 minus its distance as a share of the largest possible one.

An n-gram is a 64-bit number with 21 bits a character, so that a text's n-grams are shifts of one array of code points.
Learning sorts and counts them for each task and language, and only distinct n-grams with their counts are shuffled.

Defined results: null text or text without a letter is `und` with score 0; a null language teaches nothing; without
any labelled text every document is `und`. Texts are read whole, whatever their length; repeated rows get equal results;
n-grams that tie in frequency are taken by their number; an empty table gives no row. Other columns stay, but lang_pred,
score and _found are replaced where df has them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, table

PROFILE = 400
BLANK, FIRST, BITS = 1, 2, np.uint64(21)
#: n-grams that a task holds for a language before it counts them.
HELD = 2_000_000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its number in an n-gram: FIRST and up for letters, BLANK for all else."""
    every = np.arange(0x110000, dtype=np.uint64) + np.uint64(FIRST)
    every[[not chr(i).isalpha() for i in range(0x110000)]] = BLANK
    return every


def grams_of(text: str | None) -> np.ndarray:
    """The n-grams of one to three characters in a text's words, each word led and ended by a blank."""
    codes = letters()[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)] if text else np.empty(0, np.uint64)
    c = np.concatenate([[np.uint64(BLANK)], codes, [np.uint64(BLANK)]])
    word = c != BLANK
    c = c[word | np.concatenate([[True], word[:-1]])]
    if len(c) < 2 or c[1] == BLANK:
        return np.empty(0, np.uint64)
    two = c[:-1] << BITS | c[1:]
    three = c[:-2] << (BITS + BITS) | two[1:]
    return np.concatenate([c[c != BLANK], two, three[c[1:-1] != BLANK]])


def counted(grams: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order, and how often each occurs."""
    if weight is None:
        grams = np.sort(grams)
    else:
        order = np.argsort(grams, kind="stable")
        grams, weight = grams[order], weight[order]
    if not len(grams):
        return grams, np.empty(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    n = np.diff(np.append(start, len(grams))) if weight is None else np.add.reduceat(weight, start)
    return grams[start], n


def spelled(gram: int) -> str:
    parts = [(gram >> k) & 0x1FFFFF for k in (42, 21, 0)]
    return "".join(" " if p == BLANK else chr(p - FIRST) for p in parts if p)


def gram_id(gram: str) -> int:
    out = 0
    for ch in gram:
        out = out << 21 | (BLANK if ch == " " else ord(ch) + FIRST)
    return out


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n): the n-grams of this task's texts, counted for each language."""
    held: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}
    done: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def settle(lang: str) -> None:
        g, n = counted(np.concatenate(held.pop(lang)))
        if lang in done:
            g, n = counted(np.concatenate([done[lang][0], g]), np.concatenate([done[lang][1], n]))
        done[lang], size[lang] = (g, n), 0

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            held.setdefault(lang, []).append(grams_of(text))
            size[lang] = size.get(lang, 0) + len(held[lang][-1])
            if size[lang] > HELD:
                settle(lang)
    for lang in list(held):
        settle(lang)
    for lang, (g, n) in done.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def learn_profiles(df: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, list[str]]:
    """Each language's most frequent n-grams in order. What comes to the driver is languages x size."""
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    totals = rows.mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size).select("lang", "gram", "rank").collect()
    out: dict[str, list[str]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(spelled(r["gram"]))
    return out


class Profiles:
    """Looks up, for the ids of n-grams, their rank in every profile."""

    def __init__(self, profiles: dict[str, list[str]]):
        self.names = sorted(profiles)
        every = {g: gram_id(g) for p in profiles.values() for g in p}
        self.ids = np.array(sorted(every.values()), dtype=np.uint64)
        self.size = max(map(len, profiles.values()), default=0)
        self.ranks = np.full((len(self.ids) + 1, len(self.names)), -1)
        for k, name in enumerate(self.names):
            for rank, g in enumerate(profiles[name]):
                self.ranks[np.searchsorted(self.ids, np.uint64(every[g])), k] = rank

    def classify(self, text: str | None) -> tuple[str, float]:
        ids, n = counted(grams_of(text))
        if not len(ids) or not self.names:
            return "und", 0.0
        top = ids[np.argsort(-n, kind="stable")[: self.size]]
        at = np.searchsorted(self.ids, top)
        at[at == len(self.ids)] = 0
        at = np.where(self.ids[at] == top, at, len(self.ids))
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.names[best], float(1 - apart[best] / (self.size * len(top)))


@lru_cache(maxsize=4)
def loaded(profiles: tuple[tuple[str, tuple[str, ...]], ...]) -> Profiles:
    return Profiles({k: list(v) for k, v in profiles})


def identify(df: DataFrame, profiles: dict[str, list[str]], text: str = "text") -> DataFrame:
    """Adds lang_pred and score. The profiles, languages x PROFILE n-grams, go to the executors with the function."""
    fixed = tuple(sorted((k, tuple(v)) for k, v in profiles.items()))

    def predict(texts: pa.Array) -> pa.Array:
        model = loaded(fixed)
        found = [model.classify(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"])

    out = df.withColumn("_found", F.arrow_udf(predict, "struct<lang_pred:string,score:double>")(F.col(text)))
    return out.select(*[f"`{c}`" for c in df.columns if c not in ("lang_pred", "score")], "_found.*")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    profiles = learn_profiles(docs.where("NOT held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
