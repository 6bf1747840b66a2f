"""The recursion of the Jaccard join at its own settings."""

from gaugeworks.llm import jaccard_join

from .test_corpus_ops import brute_groups


def test_regions_join_recursively(spark, monkeypatch):
    """Families of 40 share a piece that only some of them hold, so that it is rarer than their own shingles and all
    its holders meet in its regions; a pivot takes its own family away, and the rest goes on."""
    docs = []
    for story in range(8):
        piece = [f"s{story}p{i}" for i in range(12)]
        for family, holders in enumerate((20, 8, 3, 1)):
            own = [f"s{story}f{family}w{i}" for i in range(120)]
            for c in range(40):
                w = [*own, *piece] if c < holders else own[:]
                w[5 + c] = f"c{c}"
                docs.append((1000 * story + 100 * family + c, " ".join(w)))
    seen, outer = [], jaccard_join.outer_regions

    def watched(members, *rest):
        seen.append(members.groupBy("region").count().agg({"count": "max"}).first()[0])
        return outer(members, *rest)

    monkeypatch.setattr(jaccard_join, "outer_regions", watched)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_groups(df).collect()}
    assert got == brute_groups(docs)
    assert len(seen) >= 3 and all(b < a for a, b in zip(seen, seen[1:]))
