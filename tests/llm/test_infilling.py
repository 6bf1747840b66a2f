"""Fill-in-middle: SQL is compared in test_queries; here the odd rows, small blocks and exact round trips."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import QUERIES, infilling, oracle
from tests.conftest import SMALL, rows


def expected(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", text
    p, m, s = text[:a], text[a:b], text[b:]
    return ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")


def test_query_is_the_sql(spark, duck):
    got = QUERIES["op12_fill_in_middle"](spark, SMALL)
    want = duck.sql(oracle.INFILLING).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got.toPandas().convert_dtypes()) == rows(want.convert_dtypes())
    assert {r["form"] for r in got.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert got.where("restored_sha256 <> output_sha256").count() > 100


def test_odd_rows(spark):
    texts = [None, "", "a", "é漢字\u0000𝄞" * 50, "<P", "x<P>y", "<<S>>", "P><M", "ab" * 300_000, "é" * 700_001]
    data = [(i, t, 5, "old", "old") for i, t in enumerate(texts * 30)] + [(None, "no id", 1, "o", "o"), (3, texts[3], 5, "old", "old")]
    df = spark.createDataFrame(data, "doc_id long, text string, n int, output string, kept string")
    out = infilling.restore(infilling.fill_in_middle(df))
    assert out.columns == ["doc_id", "text", "kept", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = out.collect()
    assert len(got) == len(data)
    for r in got:
        assert (r["form"], r["output"]) == expected(r["doc_id"], r["text"]) and r["restored"] == (r["text"] or "") and r["n"] == len(r["restored"])
    assert infilling.restore(infilling.fill_in_middle(df.limit(0))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="aé漢𝄞<PSM>", max_size=12), st.sampled_from(["plain", "psm", "spm"]), st.integers(0, 12), st.integers(0, 12)), max_size=6))
@pytest.mark.parametrize("block", [4, 1 << 20])
def test_blocks_round_trip(block, cases):
    kept, infilling.BLOCK = infilling.BLOCK, block
    try:
        cases = [(t, "plain" if any(m in t for m in ("<P>", "<S>", "<M>")) else f, *sorted((a % (len(t) + 1), b % (len(t) + 1)))) for t, f, a, b in cases]
        texts, forms = pa.array([c[0] for c in cases], pa.string()), np.array([c[1] for c in cases], dtype=object)
        a, b = (np.array([c[k] for c in cases], dtype=np.int64) for k in (2, 3))
        out = infilling.build(texts, forms, a, b)
        join = {"plain": lambda p, m, s: p + m + s, "psm": lambda p, m, s: f"<P>{p}<S>{s}<M>{m}", "spm": lambda p, m, s: f"<S>{s}<P>{p}<M>{m}"}
        assert out.to_pylist() == [join[f](t[:i], t[i:j], t[j:]) for t, f, i, j in cases]
        assert infilling.rebuild(out, forms).to_pylist() == texts.to_pylist()
    finally:
        infilling.BLOCK = kept
