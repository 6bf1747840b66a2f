"""Inputs that went wrong in round 1."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import chat, embed_dedup, html_extract, pii


def test_dotted_capital_i_before_a_script():
    page = "<html><body><p>İİİ A first paragraph of the article, long enough to be text.</p><script>if (a < b) { x() }</SCRIPT><article><p>What comes after the script, word for word, is here.</p></article></body></html>"
    assert html_extract.main_text(page).endswith("What comes after the script, word for word, is here.")
    assert html_extract.main_text("<p>one two three four five six seven eight nine ten.</p><ſcript>") != ""


def test_pages_empty_long_and_with_a_text_column(spark):
    body = "<article>" + "<p>A sentence of the story, told again and again, with words.</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, body, "old"), (2, None, "old"), (3, "", "old")], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(df).collect()}
    assert got[1].count("story") == 20_000 and got[2] == got[3] == ""
    assert html_extract.extract_text(df.limit(0)).count() == 0


def test_parts_of_any_type_and_null_parts(spark):
    kind = f"conv_id long, turn int, role string, parts array<{chat.PART}>, formatted string"
    part = lambda t, text: (t, text, None, None, None, None, None)
    rows = [(1, 0, "user", [part("turn", "a"), None, part(None, "b"), part("image", None), part("put", "c")], "x"), (1, 1, "assistant", None, "y"), (2, 0, None, [None], "z")]
    got = {r["conv_id"]: r for r in chat.format_chat(spark.createDataFrame(rows, kind), content=F.col("parts")).collect()}
    assert got[1]["formatted"] == "### user: ab<|image:0|>c</turn>\n### assistant: </turn>\n" and got[2]["formatted"] == "### : </turn>\n"
    assert chat.format_chat(spark.createDataFrame([], kind), content=F.col("parts")).count() == 0


def test_very_long_turns(spark):
    text = "x </turn> ### y \\ " * 50_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 0, "user", text), (1, None, None, None)], "conv_id long, turn int, role string, text string")
    assert chat.parse_chat(chat.format_chat(df).first()["formatted"]) == [("", ""), ("user", text), ("user", text)]


def test_tiny_huge_and_tied_vectors(spark):
    rows = [(1, [1e-170, 2e-170]), (2, [1e-170, 2e-170]), (3, [1e200, 2e200]), (4, [5e-324, 0.0]), (5, [1.0, 0.0]), (6, [0.0, 0.0]), (7, [1.0, 2.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7)}


def test_k_means_splits_small_tables(spark):
    assert [embed_dedup.cells_for(n) for n in (1, 256, 257, 2000, 51_282, 10**12)] == [1, 1, 2, 3, 15, embed_dedup.CELLS]
    points = spark.createDataFrame([(bytes([i % 256, i // 256]), 4, np.eye(4)[i % 4].tobytes()) for i in range(2000)] + [(b"x", 2, np.ones(2).tobytes())], "key binary, dim int, unit binary")
    cells = embed_dedup.fit_cells(points)
    assert list(cells) == [4] and cells[4][0].shape == (3, 4) and cells[4][1].shape == (3, 3)


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("GB82 WEST 1234 5698 7654 32", ["iban"]),
        ("GB82 WEST 1234 5698 7654 33", []),
        ("my iban is GB82 WEST 1234 5698 7654 33", []),
        ("my bank account AB12 CDEF GHIJ KLMN", []),
        ("my iban is GB82 WEST 1234 5698 7654 32", ["iban"]),
        ("number 123-45-6789", []),
        ("my ssn is 123-45-6789", ["ssn"]),
    ],
)
def test_the_score_decides(text, kinds):
    spans = pii.spans_of(text)
    assert [s["kind"] for s in spans if s["kind"] not in pii.BASE] == kinds
    assert all(s["score"] >= pii.LEAST for s in spans if s["kind"] not in pii.BASE)
