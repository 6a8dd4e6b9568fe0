"""Fill-in-middle examples from an index of distinct texts.

Identical texts are grouped by their content: a 128-bit digest and, inside its bucket, the (compressed) bytes themselves, which are
combined before the shuffle, so that copies send one text a task. Each distinct text's line ends are computed once and kept as an
Elias-Fano list, a few bits a line. The narrow index is joined back to the documents by digest, and each document's seeded cut is two
selections in its text's list.

A unit is ``[^\\n]*\\n|[^\\n]+``. With ``h1`` to ``h4`` from the SHA-256 of ``seed:doc_id`` a prefix ends after the smaller of ``h1 % (n + 1)`` and
``h2 % (n + 1)`` units and the middle after the larger.

Defined results: a null text is the empty text, which has no units and stays plain; texts with a sentinel stay plain; a text without line
breaks is one unit, however long; rows without a ``doc_id`` are cut by the hash of ``seed:null``; repeated rows each get a row; equal texts of different ids
are cut in different places; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import HOT_ROWS
from .common import chunks, freed, hot_joined, record_batch, texts, written

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50

_NEWLINE = ord("\n")


def line_ends(text: str) -> np.ndarray:
    """The code points before the end of each unit, in ascending order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(points == _NEWLINE) + 1
    if len(points) and (not len(ends) or ends[-1] != len(points)):
        ends = np.append(ends, len(points))
    return ends.astype(np.int64)


class EliasFano:
    """A list of ascending numbers: ``low`` bits of each packed, and the rest as gaps in unary.

    As bytes: the count and the low bits' width as eight-byte numbers, then both bit strings.
    """

    def __init__(self, stored: bytes):
        self.n, self.width = np.frombuffer(stored, "<i8", 2).tolist()
        at = 16 + (self.n * self.width + 7) // 8
        self.low, self.high = np.frombuffer(stored[16:at], np.uint8), np.frombuffer(stored[at:], np.uint8)
        self.before = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)  # ones up to and with each byte

    @staticmethod
    def encode(numbers: np.ndarray) -> bytes:
        n = len(numbers)
        most = int(numbers[-1]) if n else 0
        width = max(0, (most // n).bit_length() - 1) if n else 0
        low = (numbers[:, None] >> np.arange(width)) & 1
        high = np.zeros((most >> width) + n if n else 0, np.uint8)
        high[(numbers >> width) + np.arange(n)] = 1
        packed = [np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes() for bits in (low, high)]
        return np.array([n, width], "<i8").tobytes() + packed[0] + packed[1]

    def select(self, k: int) -> int:
        """The ``k``-th number, from 0."""
        byte = int(np.searchsorted(self.before, k, "right"))
        earlier = int(self.before[byte - 1]) if byte else 0
        ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))
        high = 8 * byte + int(ones[k - earlier]) - k
        at = k * self.width
        held = int.from_bytes(self.low[at // 8 : (at + self.width + 7) // 8].tobytes(), "little")
        return high << self.width | held >> at % 8 & (1 << self.width) - 1

    def start(self, k: int) -> int:
        """Where the first ``k`` numbers' units end: 0 for none."""
        return self.select(k - 1) if k else 0


def drawn(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]


def form_of(text: str, h: list[int], rate: int, spm: int) -> str:
    if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return "plain"
    return "spm" if h[3] % 100 < spm else "psm"


def transformed(text: str, form: str, start: int, end: int) -> str:
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    return {"plain": text, "psm": f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", "spm": f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"}[form]


def restored(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    other, middle = rest.split(MIDDLE, 1)
    return one + middle + other if form == "psm" else other + middle + one


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def index(docs: DataFrame) -> DataFrame:
    """``digest, copies, n, ends`` of every distinct text: how many rows have it, its units and their Elias-Fano list."""
    content, spec = "digest binary, form binary", "digest binary, copies long, n long, ends binary"

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for c in chunks(b, "text"):
                said = c.column("text").to_pylist()
                yield record_batch(content, [[_digest(t) for t in said], [pack.compress(t.encode("utf-8", "surrogatepass")) for t in said]])
            freed()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            ends = [line_ends(unpack.decompress(f).decode("utf-8", "surrogatepass")) for f in b.column("form").to_pylist()]
            yield record_batch(spec, [b.column("digest"), b.column("copies"), [len(e) for e in ends], [EliasFano.encode(e) for e in ends]])
            freed()

    same = texts(docs).select("text").mapInArrow(squeezed, content).groupBy("digest", "form").agg(F.count("*").alias("copies"))
    found = written(same.mapInArrow(listed, spec), "index")
    # two contents in one bucket would need a collision of 128 bits; a list must never serve another text
    if not found.groupBy("digest").agg(F.count("*").alias("contents")).filter("contents > 1").isEmpty():
        raise RuntimeError("different texts share a digest")
    return found


def examples(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row; ``rate`` of 100 texts are cut, ``spm`` of 100 of these put the suffix first."""
    return _joined(docs, seed, rate, spm, digests=False)


def digests(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """As ``examples``, but for ``output_sha256`` and ``restored_sha256``, of the text that is rebuilt from the output, instead of ``output``."""
    return _joined(docs, seed, rate, spm, digests=True)


def _joined(docs: DataFrame, seed: int, rate: int, spm: int, digests: bool) -> DataFrame:
    with_digest = "doc_id long, text string, digest binary"

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, "text"):
                yield record_batch(with_digest, [c.column("doc_id"), c.column("text"), [_digest(t) for t in c.column("text").to_pylist()]])
            freed()

    known = index(docs)
    hot = known.filter(F.col("copies") > HOT_ROWS).select("digest")
    rows = hot_joined(texts(docs).mapInArrow(marked, with_digest), known.select("digest", "n", "ends"), "digest", "left", hot)
    spec = "doc_id long, n long, form string, prefix_chars long, middle_chars long, " + ("output_sha256 string, restored_sha256 string" if digests else "output string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            for c in chunks(b, "text"):
                out = []
                for doc, text, n, ends in zip(*(c.column(x).to_pylist() for x in ("doc_id", "text", "n", "ends")), strict=True):
                    h = drawn(doc, seed)
                    form, start, end = form_of(text, h, rate, spm), None, None
                    if form != "plain":
                        lines = EliasFano(ends)
                        start, end = (lines.start(k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
                    output = transformed(text, form, start, end)
                    out.append((doc, n, form, start, None if start is None else end - start, *((sha(output), sha(restored(output, form))) if digests else (output,))))
                yield record_batch(spec, zip(*out, strict=True))
            freed()

    return rows.select("doc_id", "text", "n", "ends").mapInArrow(cut, spec)


def sql() -> str:
    """DuckDB SQL for the rows of ``digests`` over the table ``documents``, the seeds and rates as above."""
    h = [f"('0x' || hex[{8 * k + 1}:{8 * k + 8}])::UBIGINT" for k in range(4)]
    cut = [f"CASE WHEN form <> 'plain' THEN array_to_string(units[{a}:{b}], '') END" for a, b in (("1", "lo"), ("lo + 1", "hi"), ("hi + 1", "n"))]
    return f"""
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS hex FROM documents),
drawn AS (SELECT *, len(units) AS n, {", ".join(f"{x} AS h{k + 1}" for k, x in enumerate(h))} FROM rows),
formed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS lo, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS hi,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (SELECT *, {", ".join(f"{x} AS {name}" for x, name in zip(cut, ("prefix", "middle", "suffix"), strict=True))} FROM formed),
put AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
  ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output FROM cut)
SELECT doc_id, n, form, length(prefix) AS prefix_chars, length(middle) AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output ELSE prefix || middle || suffix END) AS restored_sha256 FROM put"""
