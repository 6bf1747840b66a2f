"""Cross-tokenizer alignment by lockstep vectorised merging.

A byte-level and a piece tokenizer cut the same bytes. A task lays the tokens of many documents on one line of bytes and
holds one pointer pair (A token, B token) for each document; long documents get a pair for every LANE bytes. At each
step a NumPy state vector compares where the two tokens of all pairs end: a pair whose ends agree emits a link and a cut
and advances on both sides, else the side that ends first advances. Finished pairs are compacted away.

Two tokens that end together cover the same last bytes, so the bytes of one are a suffix of the other's. The id pairs
that can be linked are therefore listed from the two vocabularies alone (`Vocabulary.pairs`, below a million): corpus
counts are sums over that list, which is small enough for the driver and a broadcast whatever the corpus.

Defined results: texts that are null or empty, or whose tokens do not spell a blank and the text, have no tokens:
zeros and empty lists. Special tokens' strings are plain text. Repeated rows count each; ties for a B id's highest count
are all best. Texts of any length are aligned whole; an empty table gives no row. Other columns stay; one named like a
result is replaced.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .packing import encoding

#: Bytes of a document that one pair of pointers goes through.
LANE = 512
#: Characters of text that are laid on one line at a time; a longer text is alone on its line.
LINE = 1 << 19
FOUND = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>"


class Vocabulary:
    """Both tokenizers, the bytes of each id, and the id pairs that can end together."""

    def __init__(self, ranks_path: str, model_path: str):
        import sentencepiece

        self.a, self.b = encoding(ranks_path), sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.a_bytes = [self.a.decode_single_token_bytes(i) if i < self.a.n_vocab else b"" for i in range(self.a.n_vocab)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.IsByte(i) else b"" if self.b.IsControl(i) or self.b.IsUnknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.IdToPiece, range(self.b.GetPieceSize())))]
        self.a_size, self.b_size = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes))
        written = np.arange(max(len(self.a_bytes), len(self.b_bytes))).astype("S")
        #: Each id in decimal digits, right-aligned by zero bytes, and a last column for what follows it.
        self.decimals = np.zeros((len(written), written.itemsize + 1), np.uint8)
        for n in range(1, written.itemsize + 1):
            rows = np.flatnonzero(np.char.str_len(written) == n)
            self.decimals[rows, -n - 1 : -1] = written[rows].astype(f"S{n}").view(np.uint8).reshape(-1, n)
        self.decimal_size = np.char.str_len(written) + 1

    @property
    def pairs(self) -> np.ndarray:
        """a << 32 | b of all id pairs of which one's bytes are a suffix of the other's, sorted."""
        if not hasattr(self, "_pairs"):
            found, ids = set(), ({}, {})
            for of, side in zip(ids, (self.a_bytes, self.b_bytes), strict=True):
                for i, x in enumerate(side):
                    of.setdefault(x, []).append(i)
            for a, x in enumerate(self.a_bytes):
                found.update(a << 32 | b for k in range(len(x)) for b in ids[1].get(x[k:], ()))
            for b, x in enumerate(self.b_bytes):
                found.update(a << 32 | b for k in range(len(x)) for a in ids[0].get(x[k:], ()))
            self._pairs = np.array(sorted(found), dtype=np.int64)
        return self._pairs

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of both sides for each text, None where they do not spell a blank and the text."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            raw = b" " + text.encode()
            a = self.a.encode_to_numpy(raw.decode(), disallowed_special=())
            same = text and self.a.decode_bytes(a.tolist()) == raw and b"".join([self.b_bytes[i] for i in b]) == raw
            out.append((a.astype(np.int64), np.array(b, dtype=np.int64)) if same else None)
        return out


@lru_cache(maxsize=2)
def vocabulary(ranks_path: str, model_path: str) -> Vocabulary:
    return Vocabulary(ranks_path, model_path)


def lockstep(a_end: np.ndarray, b_end: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of all ends that the two sides share, in order. Ends ascend and both sides end together;
    begins: byte offsets, ascending from 0, at each of which a pair of pointers sets out for the next."""
    if not len(a_end):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    until = np.append(begins[1:], a_end[-1])
    a, b = (np.searchsorted(ends, begins, side="right") for ends in (a_end, b_end))
    found_a, found_b = [], []
    going = (a < len(a_end)) & (b < len(b_end))
    a, b, until = a[going], b[going], until[going]
    while len(a):
        x, y = a_end[a], b_end[b]
        both = x == y
        here = both & (x <= until)
        found_a.append(a[here])
        found_b.append(b[here])
        low = np.minimum(x, y)
        a, b = a + (x <= y), b + (y <= x)
        going = low < until
        if not going.all():
            a, b, until = a[going], b[going], until[going]
    at_a, at_b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(at_a, kind="stable")
    return at_a[order], at_b[order]


class Line:
    """Documents whose tokens lie on one line of bytes, and their shared ends."""

    def __init__(self, vocab: Vocabulary, tokens: list[tuple[np.ndarray, np.ndarray]]):
        self.decimals, self.decimal_size = vocab.decimals, vocab.decimal_size
        self.a, self.b = (np.concatenate([t[k] for t in tokens]) if tokens else np.zeros(0, np.int64) for k in (0, 1))
        a_end, b_end = np.cumsum(vocab.a_size[self.a]), np.cumsum(vocab.b_size[self.b])
        self.a_at, self.b_at = (np.cumsum([0, *(len(t[k]) for t in tokens)]) for k in (0, 1))
        edge = np.concatenate([[0], a_end])[self.a_at]
        begins = np.unique(np.concatenate([edge[:-1], np.arange(0, edge[-1], LANE)]).astype(np.int64))
        self.cut_a, self.cut_b = lockstep(a_end, b_end, begins)
        # Cuts before each document's first token.
        self.cut_at = np.searchsorted(self.cut_a, self.a_at - 1, side="right")

    def texts(self) -> list[bytes]:
        """Each document's groups as `a1,a2|b1;a3|b2,b3`."""
        if not len(self.cut_a):
            return [b""] * (len(self.a_at) - 1)
        first_a, first_b = (np.concatenate([[0], cut[:-1] + 1]) for cut in (self.cut_a, self.cut_b))
        size_a, size_b = self.cut_a + 1 - first_a, self.cut_b + 1 - first_b
        ids = np.empty(len(self.a) + len(self.b), np.int32)
        ids[np.arange(len(self.a)) + np.repeat(first_b, size_a)] = self.a
        ids[np.arange(len(self.b)) + np.repeat(self.cut_a + 1, size_b)] = self.b
        after = np.full(len(ids), ord(","), np.uint8)
        after[self.cut_a + first_b] = ord("|")
        after[self.cut_a + self.cut_b + 1] = ord(";")
        signs = self.decimals[ids]
        signs[:, -1] = after
        sizes = self.decimal_size[ids]
        to = np.concatenate([[0], np.cumsum(sizes)])[self.a_at + self.b_at]
        flat = signs.ravel()
        flat = flat[flat != 0].tobytes()
        return [flat[lo : hi - 1] if hi > lo else b"" for lo, hi in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]


def lines(vocab: Vocabulary, texts: list[str | None]):
    """(indices of documents with tokens, their Line), some megabytes at a time."""
    lo = 0
    while lo < len(texts):
        hi, size = lo + 1, len(texts[lo] or "")
        while hi < len(texts) and size + len(texts[hi] or "") <= LINE:
            size += len(texts[hi] or "")
            hi += 1
        tokens = vocab.tokens([t or "" for t in texts[lo:hi]])
        there = [i for i, t in enumerate(tokens) if t]
        yield [lo + i for i in there], Line(vocab, [tokens[i] for i in there])
        lo = hi


def digests(vocab: Vocabulary, texts: list[str | None]) -> list[dict]:
    out = [{"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "pairs": []} for _ in texts]
    for rows, line in lines(vocab, texts):
        pairs = np.searchsorted(vocab.pairs, line.a[line.cut_a] << 32 | line.b[line.cut_b]).astype(np.int32)
        for k, (i, text) in enumerate(zip(rows, line.texts(), strict=True)):
            lo, hi = line.cut_at[k : k + 2].tolist()
            out[i] = {"n_a": int(line.a_at[k + 1] - line.a_at[k]), "n_b": int(line.b_at[k + 1] - line.b_at[k]), "n_groups": hi - lo, "n_links": hi - lo, "groups_sha256": hashlib.sha256(text).hexdigest(), "pairs": pairs[lo:hi]}
    return out


def paths(ranks_path: str | None, model_path: str | None) -> tuple[str, str]:
    return ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), model_path or public_tokenizers.path("piece_bpe_32k.model")


def align(df: DataFrame, text: str = "text", ranks_path: str | None = None, model_path: str | None = None) -> DataFrame:
    """Adds a_ids and b_ids, and the groups' ends a_cuts and b_cuts: group g holds the tokens from the cut before it up
    to its own, on both sides, and its last A and B tokens are linked."""
    where = paths(ranks_path, model_path)
    names = ("a_ids", "b_ids", "a_cuts", "b_cuts")
    kind = pa.struct([(n, pa.list_(pa.int32())) for n in names])

    @F.arrow_udf(f"struct<{','.join(f'{n}:array<int>' for n in names)}>")
    def whole(texts: pa.Array) -> pa.Array:
        vocab, texts = vocabulary(*where), texts.to_pylist()
        out = [dict.fromkeys(names, [])] * len(texts)
        for rows, line in lines(vocab, texts):
            for k, i in enumerate(rows):
                (a, a2), (b, b2), (c, c2) = (at[k : k + 2] for at in (line.a_at, line.b_at, line.cut_at))
                out[i] = dict(zip(names, (line.a[a:a2].astype(np.int32), line.b[b:b2].astype(np.int32), (line.cut_a[c:c2] + 1 - a).astype(np.int32), (line.cut_b[c:c2] + 1 - b).astype(np.int32)), strict=True))
        return pa.array(out, kind)

    # A name of its own: df may hold columns that are called like the results.
    return df.withColumn("_aligned", whole(F.col(text))).select(*(f"`{c}`" for c in df.columns if c not in names), "_aligned.*")


def count_pairs(aligned: DataFrame, where: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Of every id pair that can be linked: how often it is, and whether that is its B id's highest count. What comes to
    the driver is a row for each pair at most."""

    def summed(batches):
        total = np.zeros(len(vocabulary(*where).pairs), np.int64)
        for batch in batches:
            np.add.at(total, batch.column(0).flatten().to_numpy(), 1)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["pair", "n"])

    pairs = vocabulary(*where).pairs
    counts = np.zeros(len(pairs), np.int64)
    got = aligned.select("pairs").mapInArrow(summed, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts[got["pair"].to_numpy()] = got["n"].to_numpy()
    b = pairs & 0xFFFFFFFF
    highest = np.zeros(int(b.max()) + 1, np.int64)
    np.maximum.at(highest, b, counts)
    return counts, counts == highest[b]


def alignment_digests(df: DataFrame, text: str = "text", ranks_path: str | None = None, model_path: str | None = None) -> DataFrame:
    """df without its text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256. The links are written
    once as places in the list of possible pairs, four bytes each, and read for the counts and for the result."""
    spark, where = df.sparkSession, paths(ranks_path, model_path)
    kind = pa.struct([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int32()))])
    made = [*kind.names, "n_best", "count_sum"]

    @F.arrow_udf(f"struct<{FOUND.replace(' ', ':').replace(',:', ',')}>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array(digests(vocabulary(*where), texts.to_pylist()), kind)

    kept = [f"`{c}`" for c in df.columns if c != text and c not in made]
    aligned = materialize(df.withColumn("_aligned", found(F.col(text))).select(*kept, "_aligned.*"), "aligned")
    shared = spark.sparkContext.broadcast(count_pairs(aligned, where))

    @F.arrow_udf("struct<n_best:bigint,count_sum:bigint>")
    def over(pairs: pa.Array) -> pa.Array:
        counts, best = shared.value
        at = pairs.flatten().to_numpy()
        to = np.concatenate([[0], np.cumsum(pairs.value_lengths().fill_null(0).to_numpy())])
        sums = (np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)]) for x in (best, counts))
        return pa.StructArray.from_arrays([pa.array(s[to[1:]] - s[to[:-1]]) for s in sums], ["n_best", "count_sum"])

    out = aligned.withColumn("_over", over("pairs"))
    return out.select(*kept, "n_a", "n_b", "n_groups", "n_links", "_over.n_best", "_over.count_sum", "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
