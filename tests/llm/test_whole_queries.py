"""Whole queries of media columns and language ID against plain versions of themselves."""

import hashlib
import math
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from gaugeworks.llm import QUERIES, langid, media
from tests.conftest import SMALL


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()


def plain_png(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, idat, size = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        size = struct.unpack(">II", body[:8]) if kind == b"IHDR" else size
        idat += body if kind == b"IDAT" else b""
        at += 12 + n
    raw, out, above = zlib.decompress(idat), [], [0] * size[0]
    for y in range(size[1]):
        line = raw[y * (size[0] + 1) : (y + 1) * (size[0] + 1)]
        above = [(v + (above[x] if line[0] == 2 else 0)) % 256 for x, v in enumerate(line[1:])]
        assert line[0] in (0, 2)
        out.append(above)
    return out


def plain_hash(rows):
    height, width = len(rows), len(rows[0])
    mean = lambda v: sum(v) / len(v)
    cells = lambda n: [range(k * n // 32, max(k * n // 32 + 1, (k + 1) * n // 32)) for k in range(32)]
    small = [[mean([rows[y][x] for y in ys for x in xs]) for xs in cells(width)] for ys in cells(height)]
    wave = lambda k, x: math.cos(math.pi * (2 * x + 1) * k / 64)
    low = [round(sum(small[y][x] * wave(u, y) * wave(v, x) for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = float(np.median(low[1:]))
    bits = "0" + "".join("1" if x > middle else "0" for x in low[1:])
    return f"{int(bits, 2):016x}"


def test_media_query(spark):
    stored = {r["doc_id"]: r for r in media.store_media(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")).collect()}
    got = {r["doc_id"]: r for r in QUERIES["op6_media"](spark, SMALL).collect()}
    docs = documents(spark)
    assert len(got) == len(docs)
    for k, d in enumerate(docs):
        raw = (d["text"] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        png, r = bytes(stored[d["doc_id"]]["media"]), got[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest())
        if k % 10 == 0:
            rows = plain_png(png)
            assert bytes(v for line in rows for v in line) == payload and r["feature"] == plain_hash(rows)


def test_media_odd_rows(spark):
    kind = "doc_id long, text string, n_bytes string, media string, features string"
    df = spark.createDataFrame([(1, None, "o", "o", "o"), (2, "", "o", "o", "o"), (3, "é" * 100_000, "o", "o", "o"), (3, "é" * 100_000, "o", "o", "o")], kind)
    out = media.with_features(media.store_media(df))
    got = out.select("doc_id", "n_bytes", "features.payload_bytes", "features.feature").collect()
    assert [tuple(r)[:3] for r in got] == [(1, 0, 64), (2, 0, 64), (3, 200_000, 200_000), (3, 200_000, 200_000)] and got[2] == got[3] and got[0][3] == got[1][3]
    assert media.with_features(media.store_media(df.limit(0))).count() == 0


def plain_grams(text):
    out, word = Counter(), ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            led = f" {word} "
            out.update(word)
            out.update(led[i : i + n] for n in (2, 3) for i in range(len(led) - n + 1))
            word = ""
    return out


def ranked(counts, size):
    return sorted(counts, key=lambda g: (-counts[g], langid.gram_id(g)))[:size]


def test_language_query(spark):
    docs = documents(spark)
    learned = {}
    for d in docs:
        if d["lang"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2:
            learned.setdefault(d["lang"], Counter()).update(plain_grams(d["text"]))
    profiles = {k: {g: i for i, g in enumerate(ranked(c, langid.PROFILE))} for k, c in sorted(learned.items())}
    got = {r["doc_id"]: r for r in QUERIES["op8_langid"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r, mine = got[d["doc_id"]], ranked(plain_grams(d["text"]), max(map(len, profiles.values())))
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2)
        if not mine:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        apart = {k: sum(abs(p[g] - i) if g in p else langid.PROFILE for i, g in enumerate(mine)) for k, p in profiles.items()}
        best = min(apart, key=lambda k: (apart[k], k))
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 - apart[best] / (langid.PROFILE * len(mine)))


def test_language_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 7.0, "x"), (2, "12 --", 7.0, "x"), (3, "the cat and the dog " * 30_000, 7.0, "x"), (3, "the cat and the dog " * 30_000, 7.0, "x"), (4, "zz", 7.0, "x")], "doc_id long, text string, score double, lang_pred string")
    profiles = {"aa": ["t", "h", "e"], "bb": ["q"], "cc": ["q"]}
    got = [tuple(r) for r in langid.identify(df, profiles).select("doc_id", "lang_pred", "score").collect()]
    assert got[:2] == [(1, "und", 0.0), (2, "und", 0.0)] and got[2] == got[3] and got[2][1] == "aa"
    assert got[4][1:] == ("aa", 0.0)  # equally far from all: the first by name
    assert langid.identify(df.limit(0), profiles).count() == 0
