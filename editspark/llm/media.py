"""Media columns: texts stored as 8-bit grey PNG images in a binary column, read back, checked and hashed.

Written and read at the level of the format's chunks: signature, IHDR, IDAT (zlib) and IEND, each with its CRC-32.
Reading tests the signature, every checksum, the order and the stated size, inflates, and undoes all five scanline filters
with numpy. The feature is the sign pattern of the low frequencies of a two-dimensional cosine transform of the
image averaged down to 32 x 32, as 16 hexadecimal digits.

Defined results: a null text is the empty text, whose payload is 64 zero bytes; a damaged image raises ``ValueError``;
equal texts give equal values; a very long text is one image like any other; repeated and null ids each get their row's result; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, from_rows, record_batch, texts

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
SIDE, LOW = 32, 8


def payload(text: str) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of the width."""
    raw = text.encode("utf-8")
    return raw + b"\0" * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(rows: np.ndarray) -> bytes:
    """Scanlines with the filter, none, left or up, whose residues have the least absolute sum."""
    left, up = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    tried = np.stack([rows, left, up])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2)
    kind = cost.argmin(axis=0)
    return np.concatenate([kind[:, None].astype(np.uint8), tried[kind, np.arange(len(rows))]], axis=1).tobytes()


def encode(data: bytes, level: int = 6) -> bytes:
    """A grey image, ``WIDTH`` samples wide, of the bytes of a payload."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(filtered(rows), level)) + chunk(b"IEND", b"")


def unfiltered(lines: np.ndarray, width: int) -> np.ndarray:
    """Samples of scanlines, one byte a sample, each led by its filter type.

    Runs of lines of types none, left and up are undone in whole-array steps; average and Paeth lines sample by sample.
    """
    kind, rows = lines[:, 0], lines[:, 1:].copy()
    if kind.size and kind.max() > 4:
        raise ValueError("unknown scanline filter")
    is_left = kind == 1
    rows[is_left] = np.cumsum(rows[is_left], axis=1, dtype=np.uint8)
    starts = np.flatnonzero(np.r_[True, np.diff(kind) != 0]) if kind.size else []
    for k, end in zip(starts, [*starts[1:], len(rows)], strict=True):
        if kind[k] == 2:
            above = rows[k - 1 : k] if k else np.zeros((1, width), np.uint8)
            rows[k:end] = np.cumsum(np.concatenate([above, rows[k:end]]), axis=0, dtype=np.uint8)[1:]
        elif kind[k] > 2:
            for r in range(k, end):
                above = rows[r - 1].tolist() if r else [0] * width
                line, before, corner = rows[r].tolist(), 0, 0
                for c, x in enumerate(line):
                    if kind[r] == 3:
                        guess = (before + above[c]) // 2
                    else:
                        slope = before + above[c] - corner
                        guess = min((abs(slope - before), 0, before), (abs(slope - above[c]), 1, above[c]), (abs(slope - corner), 2, corner))[2]
                    before = line[c] = (x + guess) & 255
                    corner = above[c]
                rows[r] = line
    return rows


def decode(png: bytes) -> np.ndarray:
    """The samples of an 8-bit grey image without interlace, rows by columns."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, kinds, data, size = 8, [], [], None
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body, stated = png[at + 8 : at + 8 + n], png[at + 8 + n : at + 12 + n]
        if len(stated) != 4 or zlib.crc32(kind + body) != struct.unpack(">I", stated)[0]:
            raise ValueError(f"checksum of chunk {kind!r} is wrong")
        kinds.append(kind)
        if kind == b"IHDR":
            *size, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, color, interlace) != (8, 0, 0):
                raise ValueError("only 8-bit grey images without interlace")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if not size or kinds[0] != b"IHDR" or kinds[-1] != b"IEND":
        raise ValueError("chunks are missing or out of order")
    raw = zlib.decompress(b"".join(data))
    if len(raw) != size[1] * (size[0] + 1):
        raise ValueError("data don't have the stated size")
    return unfiltered(np.frombuffer(raw, np.uint8).reshape(size[1], size[0] + 1), size[0])


def _shrink(n: int) -> np.ndarray:
    """A matrix that averages n samples down (or spreads them) to ``SIDE``, by overlap."""
    edges = np.linspace(0, n, SIDE + 1)
    low, high = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(1, n + 1))
    return np.maximum(high - low, 0) * (SIDE / n)


_COSINES = np.cos(np.pi * (2 * np.arange(SIDE) + 1) * np.arange(LOW)[:, None] / (2 * SIDE))
_ACROSS = _COSINES @ _shrink(WIDTH)


def feature(samples: np.ndarray) -> str:
    """Signs of the low-frequency coefficients against their median, the mean level left out."""
    rows = len(samples)
    if rows > 16 * SIDE:  # whole rows first, so that the averaging matrix stays small
        at = np.arange(8 * SIDE) * rows // (8 * SIDE)
        samples = np.add.reduceat(samples, at, axis=0, dtype=np.float64) / np.diff(np.r_[at, rows])[:, None]
    low = np.round(_COSINES @ (_shrink(len(samples)) @ samples.astype(np.float64)) @ _ACROSS.T, 6).ravel()
    low[0] = 0.0
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def store(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` of the text and ``media``, its PNG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, "text"):
                text = c.column("text").to_pylist()
                sizes = [len(t.encode()) for t in text]
                yield record_batch("doc_id long, n_bytes long, media binary", [c.column("doc_id"), sizes, [encode(payload(t)) for t in text]])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """Decodes and checks ``media`` and computes the feature and digests of what was read."""
    spec = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, n, png in zip(*(b.column(k).to_pylist() for k in ("doc_id", "n_bytes", "media")), strict=True):
                samples = decode(png)
                raw = samples.tobytes()
                rows.append((doc, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(png), hashlib.sha256(png).hexdigest(), feature(samples)))
            yield from_rows(spec, rows)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, spec)
