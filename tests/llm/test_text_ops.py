"""Chat formatting, PII, media, HTML extraction and language ID against brute force, round trips and held-out labels."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.llm import QUERIES, chat, html_extract, langid, media, pii
from tests.conftest import SMALL

TEXTS = [None, "", " ", "\n", "a", "é\u00a0ß 漢字", "\\### Assistant: </turn> ok", "x" * 200_000, "mail a@b.c now"]


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()



# Chat formatting


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b\n", "### x"]), st.text(alphabet="\\#</turn>|: \nab", max_size=30)), max_size=4))
def test_chat_round_trip(turns):
    rows = [{"role": r, "parts": [{"type": "text", "text": t}]} for r, t in turns]
    done = chat.format_turns(rows, chat.TokenRates(), "assistant")
    assert chat.parse_chat(done["formatted"]) == turns
    got = chat.digests(done["formatted"], done["loss"])
    scored = "".join(t for r, t in turns if r == "assistant")
    assert got == {"n_turns": len(turns), "turns_sha256": sha("".join(f"{r}\n{t}\n" for r, t in turns)), "loss_chars": len(scored), "loss_sha256": sha(scored)}


def test_chat_parts_become_ordered_placeholders():
    part = lambda **k: {"type": "text", "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    parts = [part(text="see <|image:9|> "), part(type="image", ref="i.png", width=56, height=29), part(type="audio", ref="a.wav", seconds=2.0), part(type="document", ref="d.pdf", pages=2), part(type="odd", text="!")]
    done = chat.format_turns([{"role": "user", "parts": parts}], chat.TokenRates(), "assistant")
    assert done["formatted"] == "### user: see \\<|image:9|> <|image:0|><|audio:1|><|document:2|>!</turn>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in done["attachments"]] == [("image", "i.png", 4), ("audio", "a.wav", 50), ("document", "d.pdf", 1152)]
    assert done["attachment_tokens"] == 1206


def test_chat_query_and_odd_rows(spark):
    got = {r["conv_id"]: r for r in QUERIES["op1_chat_format"](spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    for c, g in rows.groupby("conv_id"):
        loss = "".join(t for r, t in zip(g.role, g.text) if r == "assistant")
        assert got[c]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in zip(g.role, g.text))) and got[c]["loss_sha256"] == sha(loss) and got[c]["n_turns"] == len(g)
    assert got[-7]["n_turns"] == 2 and got[-7]["loss_chars"] == 26
    odd = spark.createDataFrame([(None, 0, None, None, 1), (1, None, "user", "b", 1), (1, 1, "user", "a", 1), (1, 1, "user", "a", 1)], "conv_id long, turn long, role string, text string, formatted int")
    out = {r["conv_id"]: r["formatted"] for r in chat.format_chat(odd).collect()}
    assert out == {None: "### : </turn>\n", 1: "### user: b</turn>\n" + "### user: a</turn>\n" * 2}
    assert chat.format_chat(odd.limit(0)).count() == 0


# PII

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+ 0459()1", max_size=60))
def test_pii_base_spans_are_the_patterns_matches(text):
    got = [(s["kind"], s["start"], s["end"]) for s in pii.spans_of(text) if s["kind"] in pii.BASE]
    assert got == plain_spans(text)


def test_pii_validators_and_context():
    kinds = lambda t: [s["kind"] for s in pii.spans_of(t)]
    assert kinds("iban DE89 3704 0044 0532 0130 00 please") == ["iban"] and kinds("DE88370400440532013000") == []
    assert kinds("4111 1111 1111 1111") == ["card"] and kinds("4111 1111 1111 1112") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    near, far = pii.spans_of("visa card 4111111111111111")[0], pii.spans_of("4111111111111111")[0]
    assert near["score"] > far["score"]
    assert pii.redacted("a@b.cc or +1 (988) 555-2485") == "[EMAIL] or [PHONE]" and pii.redacted(None) is None


def test_pii_long_texts_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1.1.1." * 50_000, "+1 " + "(" * 300_000, "1 " * 150_000):
        pii.spans_of(text)


def test_pii_query(spark):
    got = {r["doc_id"]: r for r in QUERIES["op10_pii"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        base = plain_spans(r["text"] or "")
        assert got[r["doc_id"]]["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert got[r["doc_id"]]["n_email"] == sum(k == "email" for k, _, _ in base)
    odd = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(8, TEXTS[8], 1)], "doc_id long, text string, kind int")
    out = pii.find_pii(odd)
    assert out.columns == ["doc_id", "text", "kind", "pii"] and out.where(F.size("pii") == 1).count() == 2
    assert pii.find_pii(odd.limit(0)).count() == 0


# Media


@pytest.mark.parametrize("kind", range(5))
def test_png_reader_undoes_every_filter(kind):
    rng = np.random.default_rng(kind)
    x = rng.integers(0, 256, (6, 64), dtype=np.uint8)
    rows, before = [], np.zeros(64, np.uint8)
    for line in x:
        left, corner = np.concatenate([[0], line[:-1]]).astype(int), np.concatenate([[0], before[:-1]]).astype(int)
        up = before.astype(int)
        p = left + up - corner
        guess = [0 * left, left, up, (left + up) // 2, None][kind]
        if kind == 4:
            d = np.stack([abs(p - left), abs(p - up), abs(p - corner)])
            guess = np.choose(d.argmin(axis=0), [left, up, corner])
        rows.append(np.concatenate([[kind], (line - guess) & 255]).astype(np.uint8))
        before = line
    head = media.struct.pack(">IIBBBBB", 64, 6, 8, 0, 0, 0, 0)
    data = media.SIGNATURE + media.chunk(b"IHDR", head) + media.chunk(b"IDAT", zlib.compress(np.stack(rows).tobytes())) + media.chunk(b"IEND", b"")
    assert (media.read_png(data) == x).all()


def test_png_checks_what_it_reads():
    good = media.encode("hello")
    assert media.read_png(good).tobytes() == b"hello" + b"\0" * 59
    for bad in (good[:-1], good[:40] + bytes([good[40] ^ 1]) + good[41:], b"x" + good):
        with pytest.raises((ValueError, zlib.error)):
            media.read_png(bad)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300))
def test_media_round_trip(text):
    raw = text.encode()
    f = media.features(len(raw), media.encode(text))
    payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
    assert f["payload_sha256"] == hashlib.sha256(payload).hexdigest() and f["tail_crc32"] == zlib.crc32(payload[-64:]) and len(f["feature"]) == 16


def test_media_query(spark):
    odd = spark.createDataFrame([(i, t, "m") for i, t in enumerate(TEXTS)], "doc_id long, text string, extra string")
    got = {r["doc_id"]: r for r in media.with_features(media.store_media(odd)).select("doc_id", "features.*").collect()}
    assert got[0]["payload_bytes"] == 64 and got[0]["feature"] == got[1]["feature"] and got[7]["n_bytes"] == 200_000
    assert QUERIES["op6_media"](spark, SMALL).count() == 200


# HTML

PAGE = """<html><head><title>x</title><script>var t = "</p>";</script></head><body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header>
<div class="cookie-notice">We use cookies to improve, ok.</div><div class="page-with-sidebar"><main><h1>Real &amp; title</h1><p>First   paragraph, with enough
words to count. It goes on.<p>Second <a href=x>linked</a> one.</p><div class="ad">Buy now!</div><form><p>Subscribe to us now, please do.</p></form></main>
<aside><p>Related story, that is long and has sentences. Really it has.</p></aside><section id="comments"><article class="comment"><p>I think this is a great
article, it has many words and sentences. Thanks.</p></article></section></div><footer>&copy; 2020 all rights.</footer></body></html>"""


def test_html_keeps_the_article_only():
    assert html_extract.main_text(PAGE) == "Real & title\n\nFirst paragraph, with enough words to count. It goes on.\n\nSecond linked one."
    for empty in (None, "", "<", "<p", "<!-- x", "<script>var a = 1", "<div></div>"):
        assert html_extract.main_text(empty) in ("", "<", "<p")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 4), st.floats(0, 4)), min_size=1, max_size=7), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.floats(0.01, 2)), max_size=8))
def test_min_cut_is_minimal(costs, edges):
    n = len(costs)
    edges = [(a % n, b % n, w) for a, b, w in edges if a % n != b % n]
    cut = lambda keep: sum(b if k else c for (c, b), k in zip(costs, keep)) + sum(w for a, b, w in edges if keep[a] != keep[b])
    got = html_extract.min_cut([c for c, _ in costs], [b for _, b in costs], edges)
    best = min(cut([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
    assert cut(got) == pytest.approx(best, abs=1e-6)


def test_html_query_takes_whole_articles(spark):
    import html

    got = {r["page_id"]: r["text"] for r in QUERIES["op7_html_extract"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>|<br>", "", p)).split()) for p in re.split(r"</?(?:h1|p)>", inner))
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)
    odd = spark.createDataFrame([(1, None, "t"), (2, PAGE, "t"), (2, PAGE, "t")], "page_id long, html string, text string")
    assert sorted(len(r["text"]) for r in html_extract.extract_text(odd).collect())[0] == 0


# Language ID


def test_langid_held_out_accuracy(spark):
    got = QUERIES["op8_langid"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95


def test_langid_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "123 !!", None), (5, "the dog", None), (5, "the dog", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, langid.learn_profiles(df)).collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == 6 and by[3] == by[4] == ("und", 0.0) and by[5][0] == "en" and by[2][0] == "de"
    assert langid.learn_profiles(df.limit(0)) == {} and langid.identify(df, {}).where("lang_pred <> 'und'").count() == 0


def test_langid_distance_is_out_of_place():
    p = langid.Profiles({"x": ["a", "b", "c"], "y": ["c", "b", "a"]})
    name, score = p.classify("a")
    assert name == "x" and 0 <= score <= 1
