"""Disguises, the character model and small sources of review round 1."""

import random

import pytest

from gaugeworks.llm import mixing, toxicity


def test_character_model_keeps_rare_trigrams_and_all_totals(spark):
    rnd = random.Random(8)
    word = lambda: "".join(chr(0xAC00 + rnd.randrange(11_000)) for _ in range(3))
    rows = [(" ".join([word() for _ in range(150)] * 2),) for _ in range(120)] + [("moron monk",)]
    model = toxicity.learn_characters(spark.createDataFrame(rows, "text string"))
    assert len(model.grams) > 60_000
    assert [model.log_p(*g) for g in (("mo", "r"), ("or", "o"), ("zz", "q"))] == pytest.approx([-0.693147, 0, model.unseen], abs=1e-4)
    assert model.log_p("xo", "r") == pytest.approx(toxicity.BACKOFF + toxicity.math.log(1 / 3), abs=1e-4)


def test_disguises_reach_the_decoder(spark):
    rnd = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "table", "light", "grass", "of"]
    rows = []
    for i in range(800):
        w = [rnd.choice(words) for _ in range(12)]
        if toxic := i % 4 == 0:
            w[rnd.randrange(12)] = rnd.choice(["moron", "idiot", "scumbag", "stupid", "ass"])
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learned = toxicity.learn_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    disguised = [
        "m" + "o" * 80 + "ron", "table/" * 12 + "m0r0n/1d10t", "a$$", "@$$", "1d107", "a55", "iddiot", "stuupiid", "i d i o t", "i  d\ti\no t", "i d ! 0 t",
        "a s s", "m o r o n i d i o t", "m0r0n." * 5000,
    ]
    clean = ["grass", "light/table", "alpha.beta", "2024", "gamma 12 of 30", "a b c", "table-stone " * 20]
    probe = spark.createDataFrame([(i, f"alpha {t} beta") for i, t in enumerate(disguised + clean)], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(probe, learned).collect()}
    assert [t[:20] for i, t in enumerate(disguised) if not got[i]] == []
    assert [t[:20] for i, t in enumerate(clean) if got[len(disguised) + i]] == []


def test_small_sources_are_settled_beside_large_ones(spark):
    rnd = random.Random(9)
    rows = [(i, "hot", rnd.randrange(50, 300)) for i in range(20_000)]
    for k, items in enumerate([100, 100, 100, 200, 250, 300, 400, 700] * 2):
        rows += [(100_000 + 1000 * k + i, f"s{k:02d}", 20_000 if i == 0 else 200 + i % 7) for i in range(items)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), weights=(80, *[1] * 16)).collect()
    target, taken = {}, {}
    for r in got:
        target[r["source"]] = r["target"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    assert len(got) == len(rows)
    assert {s: round(taken[s] - target[s]) for s in target if abs(taken[s] - target[s]) > 210} == {}
