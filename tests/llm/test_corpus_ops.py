"""Mixing, packing, toxicity, near-duplicate joins and the pipeline against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.llm import QUERIES, embed_dedup, jaccard_join, mixing, packing, toxicity
from gaugeworks.llm.common import connected_components
from tests.conftest import SMALL

# Mixing


def water_fill(sizes: dict, cap: int = 3) -> dict:
    """Shares by weight with the excess over each cap reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, out, open_ones = float(sum(sizes.values())), {}, set(names)
    while open_ones:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in open_ones) for s in open_ones}
        over = {s for s in open_ones if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return out | share
        out |= {s: cap * sizes[s] for s in over}
        open_ones -= over
    return out


def check_mix(rows, got, most=None):
    sizes, largest = Counter(), Counter()
    for _, source, n in rows:
        sizes[source] += n
        largest[source] = max(largest[source], n)
    targets, taken = water_fill(sizes), Counter()
    for r in got:
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["source_size"] == sizes[r["source"]] and r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= (largest[s] if most is None else most)


def test_mix_meets_targets_and_repeats(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "b", "c", None]) if i % 3 else "hot", rnd.randrange(400)) for i in range(3000)] + [(7000, "tiny", 5), (7001, "tiny", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(df.repartition(3)).collect()
    assert len(got) == len(rows)
    check_mix(rows, got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))


def test_mix_odd_rows(spark):
    kind = "doc_id long, source string, size long"
    rows = [(1, "a", 5)] * 4 + [(None, None, 3), (2, "b", 0), (3, "b", 10)]
    got = mixing.mix(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 7 and len({r["copies"] for r in got if r["doc_id"] == 1}) == 1
    assert mixing.mix(spark.createDataFrame([], kind)).count() == 0
    assert all(r["copies"] == 0 for r in mixing.mix(spark.createDataFrame([(1, "a", 0)], kind)).collect())


def test_mix_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    rows = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs]
    source = {r["doc_id"]: r["source"] for r in docs}
    got = [r.asDict() | {"source": source[r["doc_id"]], "copies": r["taken"] // r["size"] if r["size"] else 0} for r in QUERIES["op2_mixing"](spark, SMALL).collect()]
    assert {(r["doc_id"], r["size"]) for r in got} == {(d, n) for d, _, n in rows}
    check_mix(rows, got)


# Packing


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_places_every_length_once(lengths):
    counts = Counter(lengths)
    made = Counter()
    for combo, times in packing.plan(counts, 64):
        assert sum(combo) <= 64
        for k in combo:
            made[k] += times
    assert made == counts


def test_plan_is_no_worse_than_best_fit_and_uses_pairs_and_triples():
    rnd = random.Random(3)
    for sizes in ([rnd.randint(200, 700) for _ in range(3000)], [min(1024, 1 + int(rnd.lognormvariate(5.5, 1))) for _ in range(3000)]):
        counts = Counter(sizes)
        planned = packing.plan(counts)
        left, plain = packing.Lengths(counts), 0
        while left.n:
            plain += left.take(packing.best_fit(left, 1024))
        assert sum(t for _, t in planned) <= plain
        assert sum(t for c, t in planned if len(c) in (3, 4) and sum(c) == 1024) > 20
    assert packing.plan({70: 1, 20: 1, 10: 1}, 100) == [((70, 20, 10), 1)]
    assert packing.plan({60: 1, 22: 1, 13: 1, 5: 1}, 100) == [((60, 22, 13, 5), 1)]


def test_plan_fills_gaps_exactly():
    assert sum(t for _, t in packing.plan({60: 5, 40: 5, 30: 10, 70: 2, 20: 2, 10: 2}, 100)) == 10
    assert sum(t for _, t in packing.plan(dict.fromkeys(range(1, 101), 3), 100)) == pytest.approx(3 * 5050 / 100, abs=2)


@pytest.mark.parametrize("text", ["", "a", "Hello  world\n\n\tx", "it's 12³ ½ – “q”\u2028\x1cz", "<|endoftext|> b", "é" * 50, "a" * 3000])
def test_ids_are_the_tokenizers(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids + [2]
    assert packing.token_ids(text, public_tokenizers.path("byte_bpe_50k.tiktoken")).tolist() == want


def test_packing_with_clashing_columns_and_repeated_rows(spark):
    names = ["length", "piece", "start", "ids_crc32", "offset", "sequence_id", "bucket", "row", "n", "salt"]
    df = spark.createDataFrame([(1, "a b c", *[9] * len(names))] * 3 + [(None, None, *[9] * len(names))] * 5000, ["doc_id", "text", *names])
    made = packing.pack(packing.tokenize(df.repartition(3), keep_ids=False).drop("ids"))
    assert sorted(made.columns) == sorted({"doc_id", *names, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"})
    rows = made.collect()
    assert len(rows) == 5003 and {r["length"] for r in rows if r["doc_id"] is None} == {1} and {(r["bucket"], r["row"], r["n"], r["salt"]) for r in rows} == {(9, 9, 9, 9)}
    assert check_packed(rows, [(1, "a b c")] * 0) == 5


def check_packed(rows, texts):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["start"], r["piece"], r["length"], r["ids_crc32"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    import public_tokenizers

    for doc, text in texts:
        ids, at = packing.token_ids(text, public_tokenizers.path("byte_bpe_50k.tiktoken")), 0
        for k, (start, piece, length, crc) in enumerate(sorted(by_doc[doc])):
            assert (start, piece) == (at, k) and crc == zlib.crc32(ids[at : at + length].tobytes()) and (length == 1024 or k == 0)
            at += length
        assert at == len(ids)
    return len(by_sequence)


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    rows = QUERIES["op3_packing"](spark, SMALL).collect()
    n = check_packed(rows, [(r["doc_id"], r["text"]) for r in docs])
    gaps, best = [], 0
    for length in sorted((r["length"] for r in rows), reverse=True):
        fit = min((g for g in gaps if g >= length), default=None)
        if fit is None:
            best, fit = best + 1, 1024
        else:
            gaps.remove(fit)
        gaps.append(fit - length)
    assert n <= best * 1.01 + 1


def test_packing_odd_rows(spark):
    from gaugeworks.llm.common import materialize

    texts = [(1, None), (2, ""), (3, "word " * 5000), (4, "x"), (4, "x"), (None, "y")]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, extra int")
    pieces = materialize(packing.tokenize(df), "pieces")
    rows = packing.pack(pieces).collect()
    assert "extra" in pieces.columns and sum(r["doc_id"] == 4 for r in rows) == 2
    check_packed([r for r in rows if r["doc_id"] in (1, 2, 3)] and rows, [(1, None), (2, ""), (3, "word " * 5000)])
    assert packing.pack(materialize(packing.tokenize(df.limit(0)), "none")).count() == 0


# Toxicity


def toy(spark):
    rnd = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "table", "light"]
    rows = []
    for i in range(600):
        w = [rnd.choice(words) for _ in range(12)]
        if toxic := i % 4 == 0:
            w[rnd.randrange(12)] = rnd.choice(["moron", "idiot", "scumbag"])
        rows.append((i, " ".join(w), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_restores_and_scores(spark):
    df = toy(spark)
    learned = toxicity.learn_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    probe = [(1, "alpha m0r0n beta"), (2, "alpha i d i o t beta"), (3, "alpha moroooon beta"), (4, "s.c.u.m.b.a.g"), (5, "alpha beta gamma 2024 room 12"), (6, None), (7, ""), (8, "alpha " * 30000 + "!d!ot")]
    odd = spark.createDataFrame([(i, t, 0.5) for i, t in probe], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(odd, learned).collect()}
    assert [got[i]["predicted"] for i in range(1, 9)] == [1, 1, 1, 1, 0, 0, 0, 1]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_without_labels(spark):
    df = toy(spark)
    none = toxicity.learn_toxicity(df.select("doc_id", "text"), df.select("doc_id", F.lit(None).cast("int").alias("toxic")))
    assert {r["score"] for r in toxicity.score_toxicity(df.select("doc_id", "text"), none).collect()} == {0.0}
    none = toxicity.learn_toxicity(df.limit(0).select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert toxicity.score_toxicity(df.limit(0), none).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    r = got.where("held_out").agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int")).alias("accuracy")).first()
    assert r["accuracy"] >= 0.85


# Near duplicates


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(110)] + [(0, i) for i in range(300, 340)] + [(i, i + 1) for i in range(500, 560)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_groups(docs):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def near_copies(n, seed=5):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(1, 90))] for _ in range(15)]
    passage = [rnd.choice(words) for _ in range(60)]
    docs = [(9000, None), (9001, ""), (9002, "  \n"), (9003, "A b"), (9004, "a B"), (9005, "long " * 40_000)]
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4])):
            k, r = rnd.randrange(len(w)), rnd.random()
            if r < 0.4:
                w[k] = rnd.choice(words)
            elif r < 0.7:
                w.insert(k, rnd.choice(words))
            elif len(w) > 1:
                del w[k]
        if rnd.random() < 0.3:
            w = w[: len(w) // 2] + passage + w[len(w) // 2 :]
        docs.append((i, " ".join(w)))
    return docs


@pytest.mark.parametrize("block", [1024, 8])
def test_jaccard_join_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    docs = near_copies(250)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, point string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_groups(df).collect()}
    assert got == brute_groups(docs)


def test_jaccard_join_odd_rows(spark):
    kind = "doc_id long, text string"
    assert jaccard_join.similar_groups(spark.createDataFrame([], kind)).count() == 0
    got = jaccard_join.similar_groups(spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, None), (6, None)], kind)).collect()
    assert sorted(map(str, got)) == sorted(map(str, [*[r for r in got if r["n_shingles"] == 1 and r["component_id"] == 5], *[r for r in got if r["n_shingles"] == 0]])) and len(got) == 5


def brute_links(rows):
    ok = [i for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([v for i, v in rows if i in set(ok)], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    n, up = dict.fromkeys((i for i, _ in rows), 0), {i: i for i, _ in rows}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(ok)):
        for b in np.flatnonzero(x[a] @ x[:a].T >= 0.95):
            n[ok[a]] += 1
            n[ok[b]] += 1
            p, q = sorted((root(ok[a]), root(ok[b])))
            up[q] = p
    return {i: (n[i], root(i), root(i) == i) for i in n}


def test_embedding_links_are_exact(spark, monkeypatch):
    for name, value in (("SPREAD", 2), ("BLOCK", 16), ("PANEL", 7)):
        monkeypatch.setattr(embed_dedup, name, value)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(v) for v in np.float32(centres[i % 6] + rng.normal(size=8) * 0.22)]) for i in range(300)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None] + [1.0] * 7), (1004, rows[0][1]), (1005, [2 * v for v in rows[0][1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_vectors(df).collect()}
    assert got == brute_links(rows)
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_embedding_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in QUERIES["op5_embed_dedup"](spark, SMALL).collect()}
    assert got == brute_links(rows)


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    from gaugeworks.llm.common import materialize

    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]
    seen = {}
    for name, stage in P.STAGES[:-1]:
        out = materialize(stage(spark, docs, SMALL), name)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = (docs.collect(), out.collect())
        docs = out
    before, after = seen["near_duplicates"]
    groups = brute_groups([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"] for r in after} == {root for _, root in groups.values()}
    before, after = seen["pii"]
    assert len(before) == len(after) and all(r["n_chars"] == len(r["text"]) and "@mail" not in r["text"] for r in after)
    before, after = seen["mixing"]
    copies = Counter(r["doc_id"] for r in after)
    check_mix(
        rows := [(r["doc_id"], r["source"], len(r["text"].split())) for r in before],
        [{"source": s, "size": n, "copies": copies[d], "target": t, "source_size": z} for d, s, n in rows for sizes in [totals(rows)] for t, z in [(water_fill(sizes)[s], sizes[s])]],
    )
    packed = P.run(spark, SMALL).collect()
    again = P.STAGES[-1][1](spark, docs, SMALL).collect()
    assert len(packed) == len(again) and len({r["sequence_id"] for r in packed}) == len({r["sequence_id"] for r in again})


def totals(rows):
    out = Counter()
    for _, s, n in rows:
        out[s] += n
    return out


def test_pipeline_on_empty_documents(spark, tmp_path):
    import corpus_pipeline as P

    for t in ("documents", "labels"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
