"""Cross-tokenizer alignment against a plain merge of both sides' ends."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugeworks.llm import QUERIES, alignment
from tests.conftest import SMALL

VOCAB = alignment.vocabulary(*alignment.paths(None, None))


@pytest.fixture(scope="module")
def plain_tokenizer():
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def plain(text, tokenizer):
    """(n_a, n_b, groups text, linked id pairs) by sets of ends, one document at a time."""
    raw = b" " + (text or "").encode()
    a, b = tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids, VOCAB.b.encode(text or "")
    a_bytes, b_bytes = [VOCAB.a_bytes[i] for i in a], [VOCAB.b_bytes[i] for i in b]
    if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return 0, 0, "", []
    ends = [{int(e): k for k, e in enumerate(np.cumsum([len(x) for x in side]))} for side in (a_bytes, b_bytes)]
    out, links, i, j = [], [], 0, 0
    for e in sorted(ends[0].keys() & ends[1].keys()):
        p, q = ends[0][e] + 1, ends[1][e] + 1
        out.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
        links.append((a[p - 1], b[q - 1]))
        i, j = p, q
    return len(a), len(b), ";".join(out), links


def expected(texts, tokenizer):
    done = [plain(t, tokenizer) for t in texts]
    count = Counter(p for d in done for p in d[3])
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(n, m, len(links), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if n else "") for n, m, g, links in done]


NAMES = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def test_query_is_the_plain_merge(spark, plain_tokenizer):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in QUERIES["op11_token_alignment"](spark, SMALL).collect()}
    assert got == dict(zip((r["doc_id"] for r in docs), expected([r["text"] for r in docs], plain_tokenizer), strict=True))


def test_odd_rows(spark, plain_tokenizer):
    texts = [None, "", " ", "a", "  two  blanks\n\n\tand tabs ", "<|endoftext|> </s> <unk> <0x41>", "▁ is a mark", "é漢字𝄞\u0000", "a b c " * 40_000, "x" * 30_000, "same words", "same words", "ﬁ ligature Å"]
    df = spark.createDataFrame([(i, t, "old", "old") for i, t in enumerate(texts)], "doc_id long, text string, n_a string, b_ids string")
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in alignment.alignment_digests(df).collect()}
    want = expected(texts, plain_tokenizer)
    assert got == dict(enumerate(want)) and got[0] == got[1] == got[6] == (0, 0, 0, 0, 0, 0, "") and got[5][0] > 10
    for r in alignment.align(df).collect():
        n, m, groups, links = plain(r["text"], plain_tokenizer)
        cuts = list(zip([0, *r["a_cuts"]], r["a_cuts"], [0, *r["b_cuts"]], r["b_cuts"]))
        assert (len(r["a_ids"]), len(r["b_ids"]), r["n_a"]) == (n, m, "old")
        assert ";".join(",".join(map(str, r["a_ids"][a:c])) + "|" + ",".join(map(str, r["b_ids"][b:d])) for a, c, b, d in cuts) == groups
    assert alignment.alignment_digests(df.limit(0)).count() == 0 and alignment.align(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 5), min_size=1, max_size=40), st.randoms(use_true_random=False)), min_size=1, max_size=5), st.integers(1, 60))
def test_lockstep_finds_the_shared_ends(docs, lane):
    a_end, b_end, edge, at = [], [], [0], 0
    for sizes, rnd in docs:
        total = sum(sizes)
        a_end += list(at + np.cumsum(sizes))
        b_end += sorted({at + rnd.randint(1, total) for _ in range(len(sizes))} | {at + total})
        at += total
        edge.append(at)
    a_end, b_end = np.array(a_end), np.array(b_end)
    begins = np.unique(np.concatenate([edge[:-1], np.arange(0, at, lane)]))
    a, b = alignment.lockstep(a_end, b_end, begins)
    shared = np.intersect1d(a_end, b_end)
    assert np.array_equal(a_end[a], shared) and np.array_equal(b_end[b], shared)


def test_possible_pairs_are_all_suffixes():
    a, b = VOCAB.pairs >> 32, VOCAB.pairs & 0xFFFFFFFF
    assert len(VOCAB.pairs) < 1_000_000 and np.all(np.diff(VOCAB.pairs) > 0)
    for i in range(0, len(a), 997):
        x, y = VOCAB.a_bytes[a[i]], VOCAB.b_bytes[b[i]]
        assert x and y and (x.endswith(y) or y.endswith(x))
