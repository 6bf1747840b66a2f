"""PII: regular expressions propose spans, checksums confirm them, context words adjust the score.

Null text counts as empty and has no spans. Very long texts are read whole: every pattern is scanned in time
linear in the text. Repeated rows each get their own, equal, result; spans that tie in kind and start can't be, as those
of a kind don't overlap; an empty table gives no rows. Other columns pass through untouched, but one with the name of
the result is replaced.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The kinds in report order, their score on shape alone, and what a passed checksum adds. A failed checksum
# rejects a span, whatever words are near it. An SSN, which has no checksum, needs a context word.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
SHAPE = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.35, "ssn": 0.35}
CHECKED = {"card": 0.5, "iban": 0.5}
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "correo", "courriel", "kontakt"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
CONTEXT_CHARS, CONTEXT_BOOST = 40, 0.3
#: Spans of kinds beyond BASE count from this score on.
LEAST = 0.6

DIGIT = re.compile("[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match ends with its run of digits, so only the first digit of a run can begin one.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
WORDS = re.compile(r"[^\W\d_][\w-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    """ISO 13616: the first four characters go last, letters count from 10, the number leaves 1."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def emails(text: str):
    """Leftmost non-overlapping matches of a local part, @ and a dotted domain, found from each @ outwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = at + 1
        at = text.find("@", free)


def only_digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def spans_of(text: str | None) -> list[dict]:
    """All spans of a text in code points, end exclusive, by kind and then start."""
    if not text:
        return []
    found: list[tuple[str, int, int, bool]] = []
    if "@" in text:
        found += [("email", a, b, False) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span(), False))
        for m in CARD.finditer(text):
            if 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
                found.append(("card", *m.span(), True))
        if "+" in text:
            found += [("phone", *m.span(), False) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
        found += [("iban", *m.span(), True) for m in IBAN.finditer(text) if mod97(m[0].replace(" ", ""))]
        found += [("ssn", *m.span(), False) for m in SSN.finditer(text)]
    out = []
    for kind, a, b, checked in found:
        near = {w.lower() for w in WORDS.findall(text[max(0, a - CONTEXT_CHARS) : a] + " " + text[b : b + CONTEXT_CHARS])}
        score = SHAPE[kind] + checked * CHECKED.get(kind, 0) + CONTEXT_BOOST * bool(near & {*CONTEXT[kind]})
        if kind in BASE or score >= LEAST:
            out.append({"kind": kind, "start": a, "end": b, "score": round(min(score, 1.0), 3)})
    return out


SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def pii_spans(texts: pa.Array) -> pa.Array:
    """Column of texts -> column of span lists."""
    return pa.array([spans_of(t.as_py()) for t in texts], pa.list_(SPAN))


def redacted(text: str | None) -> str | None:
    """The text with each group of overlapping spans replaced by the kind of its first span, as in [EMAIL]."""
    spans = sorted(spans_of(text), key=lambda s: (s["start"], -s["end"]))
    if not spans:
        return text
    parts, done = [], 0
    for s in spans:
        if s["start"] >= done:
            parts += [text[done : s["start"]], f"[{s['kind'].upper()}]"]
        done = max(done, s["end"])
    return "".join([*parts, text[done:]])


def redact(texts: pa.Array) -> pa.Array:
    return pa.array([redacted(t.as_py()) for t in texts], pa.string())


def find_pii(df: DataFrame, text: str = "text", to: str = "pii") -> DataFrame:
    """Adds or replaces the column `to`: array of (kind, start, end, score)."""
    return df.withColumn(to, F.arrow_udf(pii_spans, SPANS)(F.col(text)))


def mask_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the spans in the text column by their kind."""
    return df.withColumn(text, F.arrow_udf(redact, "string")(F.col(text)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(*kinds: str) -> Column:
    return F.filter("pii", lambda s: s["kind"].isin(*kinds))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(of_kind(*BASE)), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )
