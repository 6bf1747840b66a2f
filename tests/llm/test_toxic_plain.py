"""The distributed character model and its readings against plain versions that hold everything in memory."""

import math
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.llm import toxicity as T

SF = "/root/testdata/sf0.001"


class PlainModel:
    """The model as dictionaries: counts of the three and two last characters of every place of every word."""

    def __init__(self, texts):
        self.three, self.two = Counter(), Counter()
        for text in texts:
            for word in T.LETTERS.findall((text or "").lower()):
                padded = f"  {word} "
                for i in range(2, len(padded)):
                    self.three[padded[i - 2 : i + 1]] += 1
                    self.two[padded[i - 1 : i + 1]] += 1
        self.led3, self.led2 = Counter(), Counter()
        for g, n in self.three.items():
            self.led3[g[:2]] += n
        for g, n in self.two.items():
            self.led2[g[:1]] += n

    def log_p(self, state, c):
        if n := self.three[state + c]:
            return math.log(n / self.led3[state])
        if n := self.two[state[1:] + c]:
            return math.log(n / self.led2[state[1:]]) + T.BACKOFF
        return T.UNSEEN


def plain_score(text, model, weights, rates, curve):
    """Every token decoded, none left out beforehand."""
    tokens, odds, begun = T.tokens_of(text), [], Counter()
    for t in tokens:
        features = {f for w in T.words_in(t, model) for f in T.features_of(w)}
        odds.append(max((weights.get(f, 0.0) for f in features), default=0.0))
        begun.update(f for f in features if f in rates)
    told = max((n * rates[f][0] - len(tokens) * rates[f][1] for f, n in begun.items()), default=0.0)
    x = max(odds, default=0.0), math.log1p(math.fsum(odds)), max(0.0, min(T.MOST_NATS, told))
    z = curve[0] + math.fsum(b * v for b, v in zip(curve[1:], x, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_scores_equal_those_of_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(T, "GROUP", 50)  # several groups of tokens
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    learned = T.learn_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = PlainModel([t for _, t in texts])
    stem = next(f[1:] for f in learned[1] if f[0] == "=" and len(f) > 5)
    odd = ["", None, stem, ".".join(stem), " ".join(stem), stem.upper() + "!!", stem[0] + stem, f"x-{stem}-y", "1" * 5000, "a1" * 2000 + stem, "l\U0001f600l 3,14 $$$", stem.replace("o", "0").replace("e", "3")]
    probe = texts + [(-i - 1, t) for i, t in enumerate(odd)] + texts[:20]
    got = T.score_toxicity(spark.createDataFrame(probe, "doc_id long, text string").repartition(5), learned).collect()
    assert len(got) == len(probe)
    want = {i: plain_score(t, model, *learned[1:]) for i, t in probe}
    assert all(abs(r["score"] - want[r["doc_id"]]) < 1e-4 for r in got)


def test_extra_columns_stay_and_names_may_clash(spark):
    own = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    docs = spark.createDataFrame([(i, f"{own(i)} " + ("spiteful zebra" if i % 2 else "calm river"), i % 2) for i in range(400)], "doc_id long, text string, toxic int")
    learned = T.learn_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    rows = docs.select("doc_id", "text", F.lit(7).alias("key"), F.lit(8).alias("read"), F.lit(9).alias("token"), F.lit(-1.0).alias("score"))
    got = T.score_toxicity(rows, learned)
    assert got.columns == ["doc_id", "text", "key", "read", "token", "score", "predicted"]
    assert {(r["key"], r["read"], r["token"], r["predicted"]) for r in got.collect()} == {(7, 8, 9, 0), (7, 8, 9, 1)}


def test_no_table_of_the_corpus_reaches_the_driver(spark):
    docs = spark.createDataFrame([(i, f"word{i} spite zebra b4d" if i % 2 else "calm river", i % 2) for i in range(80)], "doc_id long, text string, toxic int")
    model, *parts = T.learn_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert isinstance(model, T.CharacterTable) and set(vars(model)) == {"table"}
    assert vars(T.Scorer(*parts)).keys().isdisjoint({"model", "grams"})


@settings(max_examples=300, deadline=None)
@given(st.text("losertab01345!$@.-*|7 x", min_size=1, max_size=14))
def test_a_token_left_out_could_not_mark(token):
    """can_spell() may let too much through, never too little: whatever decoding gives under any model."""
    scorer = T.Scorer({"=loser": 3.0, "=at": 2.0, "bale": 2.0, "tease": 2.0}, {"orea": (1.0, 0.1)}, None)
    if T.is_plain(token.strip(T.EDGE)) or scorer.can_spell(token):
        return

    class Any:
        def __init__(self, liked):
            self.liked = liked

        def log_p(self, state, c):
            return 0.0 if (state + c).strip() in self.liked else -5.0

    for word in ("loser", "at", "bale", "tease", "orea"):
        words = T.words_in(token, Any({f"  {word} "[i : i + 3].strip() for i in range(len(word) + 1)}))
        assert not any(scorer.weight_of(words))
