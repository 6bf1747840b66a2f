"""Substring dedup against brute force over all windows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import QUERIES, substring_dedup
from tests.conftest import SMALL


def brute(docs, window=50):
    words = [(d, (t or "").encode().split()) for d, t in docs]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1) if d is not None else ():
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[n] for n in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in df.collect()), key=str)


def test_query_is_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = brute(docs)
    assert got(QUERIES["op13_substring_dedup"](spark, SMALL)) == want and sum(r[2] > 0 for r in want) > 5


def corpus(seed, n=120):
    """Passages of 30 to 120 words in random places, near copies, few distinct words in some, and runs of one word."""
    r = random.Random(seed)
    common = [[f"w{r.randint(0, 400)}" for _ in range(r.choice([30, 49, 50, 51, 90, 120]))] for _ in range(12)]
    common += [["la"] * 80, [f"x{k % 2}" for k in range(130)], [f"y{k % 9}" for k in range(75)]]
    docs = []
    for d in range(n):
        words = [f"w{r.randint(0, 5000)}" for _ in range(r.choice([0, 3, 40, 100]))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(common)
            lo = r.choice([0, 0, 5, 20])
            at = r.randint(0, len(words))
            words[at:at] = p[lo : lo + r.choice([200, 60, 45])]
        docs.append((d * 3, r.choice([" ", "\n", "  "]).join(words)))
        if d % 7 == 0 and len(words) > 60:
            near = list(words)
            near[r.randint(0, len(near) - 1)] = "changed"
            docs.append((d * 3 + 1, "\t".join(near)))
    return docs


@pytest.mark.parametrize("seed, bucket", [(1, 8 << 20), (2, 5_000), (3, 20_000)])
def test_planted_passages(spark, seed, bucket, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", bucket)
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute(docs)
    assert sum(r[2] > 0 for r in want) > 30
    assert got(substring_dedup.remove_repeats(df)) == want
    assert got(substring_dedup.remove_repeats(df, window=20)) == brute(docs, 20)


def test_segments_and_small_automata(monkeypatch):
    """Runs that segments cut are still runs of the same windows, and phrases spread over automata are still found."""
    docs = corpus(5)
    texts = [substring_dedup.joined(t) for _, t in docs if len(t.split()) >= 50]
    monkeypatch.setattr(substring_dedup, "AUTOMATON_BYTES", 200)
    for segment in (3, 40, 1 << 17):
        monkeypatch.setattr(substring_dedup, "SEGMENT", segment)
        words = substring_dedup.Words(texts, 50)
        run = words.runs()
        windows = [(t, a + k) for t, a, n in zip(run["text"], run["at"], run["count"]) for k in range(n)]
        assert windows == [(t, i) for t in range(len(texts)) for i in range(words.first[t], words.first[t + 1] - 49)]
        automata = substring_dedup.Automata()
        phrases = dict.fromkeys(words.phrases(run["anchor"]))
        for k, p in enumerate(phrases):
            automata.add(p, k, True)
        automata.compile()
        assert len(automata.done) > 3
        where, number = automata.locate(words), {p: k for k, p in enumerate(phrases)}
        assert where[run["anchor"]].tolist() == [number[p] for p in words.phrases(run["anchor"])]


def test_odd_rows(spark):
    long = " ".join(f"t{k % 1000}" for k in range(60_000))
    passage = " ".join(f"p{k}" for k in range(55))
    docs = [(5, None), (6, ""), (7, " \n "), (None, passage), (1, passage), (1, passage + " more"), (2, "é x " + passage), (2, passage), (2, passage), (8, long), (9, long + " end"), (None, None)]
    df = spark.createDataFrame([(d, t, "old", "old") for d, t in docs], "doc_id long, text string, bucket string, n_words string")
    assert got(substring_dedup.remove_repeats(df)) == brute(docs)
    kept = {r["doc_id"]: r["kept_text"] for r in substring_dedup.remove_repeats(df).where("doc_id = 9 OR doc_id = 6").collect()}
    assert kept == {9: "end", 6: ""}
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0
    assert substring_dedup.remove_repeats(df.select(F.col("doc_id").alias("key"), F.col("text").alias("body")), "key", "body").columns[0] == "key"
