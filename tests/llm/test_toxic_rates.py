"""Word beginnings that tell by the number of words that have them."""

import random

from gaugeworks.llm import toxicity


def families(spark):
    rnd = random.Random(7)
    end = lambda: "".join(rnd.choice("bdfgkaeiou") for _ in range(6))
    plain = ["alpha", "beta", "gamma", "delta", "river", "stone", "table", "light", "losen", "losenet"]
    rows = []
    for i in range(800):
        w = [rnd.choice(plain) + rnd.choice(["", "x", "y"]) for _ in range(30)]
        toxic = i % 4 == 0
        if i % 8 == 0:
            w[rnd.randrange(30)] = "loser"
        elif toxic:
            w[:4] = [f"zorbl{end()}" for _ in range(4)]
        elif i % 5 == 0:
            w[0] = f"zorbl{end()}"
        rows.append((i, " ".join(w), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_several_words_of_a_family_are_toxic_and_one_is_not(spark):
    df = families(spark)
    learned = toxicity.learn_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    weights, rates = learned[1], learned[2]
    assert {"zorb", "zorbl"} <= set(rates) and "=loser" in weights
    assert "lose" not in rates and "lose" not in weights
    rest = "alpha beta river stone table light delta gamma " * 3
    probe = [(1, rest + "zorblabag zorblebeg zorblibig zorblobog"), (2, rest + "zorblabag"), (3, rest + "loser"), (4, rest + "losen losent"), (5, rest + "z0rblabag zorbl3beg zorblibiiig z.o.r.b.l.o.b.o.g"), (6, (rest + "zorblabag ") * 5)]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(spark.createDataFrame(probe, "doc_id long, text string"), learned).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 0, 5: 1, 6: 0}
