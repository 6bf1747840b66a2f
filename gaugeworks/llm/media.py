"""Media columns: bytes stored as PNG in a binary column, read back with every check, and hashed perceptually.

The writer lays samples out 64 wide, filters rows by the row above and compresses them into one zlib stream. The
reader walks the chunks, tests each checksum, inflates, and undoes any of the five row filters with numpy. The hash is
the sign pattern of the lowest frequencies of a cosine transform of the image shrunk to 32 x 32.

Defined results: a null text is stored as an empty one; an empty one is 64 zero bytes; texts of any length are stored
whole; equal texts, repeated rows among them, give equal files and hashes, and coefficients that tie with the median
give a 0. A file with a wrong checksum, filter or length raises ValueError. An empty table gives no row. Other columns
stay; n_bytes, the media column and features are replaced where df has them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Fixed values of the file format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)

WIDTH, SIDE, LOW = 64, 32, 8
FEATURES = "struct<n_bytes:bigint,payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string>"
FEATURES_ARROW = pa.struct([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(samples: np.ndarray, level: int = 4) -> bytes:
    """An 8-bit grey image (height x width) as a PNG file."""
    height, width = samples.shape
    rows = np.full((height, width + 1), UP, dtype=np.uint8)
    rows[:, 1:] = samples
    rows[1:, 1:] -= samples[:-1]
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def chunks_of(data: bytes):
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at < len(data):
        size = struct.unpack_from(">I", data, at)[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or len(data) < at + 12 + size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} is cut or its checksum is wrong")
        yield kind, body
        at += 12 + size


def unfilter(filters: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the row filters of an image with one byte a pixel. Runs of rows with the same simple filter go at once."""
    if filters.size and filters.max() > PAETH:
        raise ValueError(f"unknown row filter {filters.max()}")
    out = rows.copy()
    cuts = np.flatnonzero(np.diff(filters)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(filters)], strict=True):
        kind, above = filters[lo] if hi > lo else NONE, out[lo - 1] if lo else np.zeros(rows.shape[1], np.uint8)
        if kind == SUB:
            out[lo:hi] = np.cumsum(rows[lo:hi], axis=1, dtype=np.uint8)
        elif kind == UP:
            out[lo:hi] = np.cumsum(rows[lo:hi], axis=0, dtype=np.uint8) + above
        elif kind in (AVERAGE, PAETH):
            for y in range(lo, hi):
                up, left, corner = (out[y - 1] if y else above * 0).astype(int), 0, 0
                for x, v in enumerate(rows[y].tolist()):
                    b = int(up[x])
                    if kind == AVERAGE:
                        guess = (left + b) // 2
                    else:
                        p = left + b - corner
                        guess = min((left, b, corner), key=lambda c: abs(p - c))
                    left, corner = (v + guess) & 255, b
                    out[y, x] = left
    return out


def read_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG file, every chunk checked."""
    parts = list(chunks_of(data))
    if not parts or parts[0][0] != b"IHDR" or parts[-1][0] != b"IEND":
        raise ValueError("the file does not go from IHDR to IEND")
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", parts[0][1])
    if (depth, colour, interlace) != (8, 0, 0):
        raise ValueError("only 8-bit grey images without interlace are read")
    raw = np.frombuffer(zlib.decompress(b"".join(body for kind, body in parts if kind == b"IDAT")), dtype=np.uint8)
    if raw.size != height * (width + 1):
        raise ValueError("the image data has a wrong length")
    raw = raw.reshape(height, width + 1)
    return unfilter(raw[:, 0], raw[:, 1:])


def cosine_basis(low: int = LOW, side: int = SIDE) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(side) + 1) * np.arange(low)[:, None] / (2 * side))


def shrunk(samples: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Means over side x side nearly equal blocks; images smaller than that repeat rows or columns."""
    for axis in (0, 1):
        n = samples.shape[axis]
        lo = np.arange(side) * n // side
        hi = np.maximum(lo + 1, (np.arange(side) + 1) * n // side)
        total = np.concatenate([np.zeros_like(samples.take([0], axis), dtype=float), np.cumsum(samples, axis=axis, dtype=float)], axis=axis)
        shape = [1, 1]
        shape[axis] = side
        samples = (total.take(hi, axis) - total.take(lo, axis)) / (hi - lo).reshape(shape)
    return samples


def perceptual_hash(samples: np.ndarray) -> str:
    """64 bits as hex: which of the 8 x 8 lowest frequencies exceed their median, the mean brightness left out."""
    basis = cosine_basis()
    low = np.round(basis @ shrunk(samples) @ basis.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def encode(text: str | None) -> bytes:
    raw = (text or "").encode()
    padded = raw + b"\0" * (-len(raw) % WIDTH or (0 if raw else WIDTH))
    return write_png(np.frombuffer(padded, dtype=np.uint8).reshape(-1, WIDTH))


def features(n_bytes: int, media: bytes) -> dict:
    samples = read_png(media)
    payload = samples.tobytes()
    return {
        "n_bytes": n_bytes, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-WIDTH:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": perceptual_hash(samples),
    }


def to_media(texts: pa.Array) -> pa.Array:
    return pa.array([encode(t.as_py()) for t in texts], pa.binary())


def media_features(n_bytes: pa.Array, media: pa.Array) -> pa.Array:
    return pa.array([features(n.as_py(), m.as_py()) for n, m in zip(n_bytes, media, strict=True)], FEATURES_ARROW)


def store_media(df: DataFrame, text: str = "text", to: str = "media") -> DataFrame:
    """Adds the binary column `to` with each text as a PNG file, and n_bytes, the text's own length in bytes."""
    return df.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")).withColumn(to, F.arrow_udf(to_media, "binary")(F.col(text)))


def with_features(df: DataFrame, media: str = "media") -> DataFrame:
    """Reads the stored files back and adds the struct column `features`."""
    return df.withColumn("features", F.arrow_udf(media_features, FEATURES)("n_bytes", media))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return with_features(stored.drop("text")).select("doc_id", "features.*")
