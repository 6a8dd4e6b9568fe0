"""Best-fit packing of documents into sequences of bounded length, by exact-complement hashing over length counts.

Documents become pieces of at most ``capacity`` tokens: only longer documents are cut, from their end, so that
their first piece is the shorter one. The plan depends on how many pieces of each length there are, and on
nothing else, so it is made from at most ``capacity`` counts, however many pieces there are:

* the longest remaining length opens a sequence; the gap is looked up in a hash index of single lengths, pair sums and triple
  sums (``Sums``), and a combination that fills it exactly is used as often as the counts of its lengths allow;
* where no combination fills the gap, the longest length that fits goes in first and the smaller gap is looked up
  again; what can't be filled exactly is a best-fit residual.

Each step uses one pattern (a combination of lengths) for as many sequences as it can, so the plan has few patterns.
A piece finds its place from its rank among the pieces of its length: ranks come from counts for each
(length, writing task), never from a sort of all pieces of a length, so a hot length isn't gathered anywhere.

Defined results: a null or empty text is the end token alone; a very long text, and one with a very long word or gap, is encoded whole and cut; repeated and null
ids are packed row by row; among equal lengths any order may come out; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .bpe import WORDS, byte_alphabet
from .common import chunks, freed, record_batch, small_or_joined, texts, written


#: Code points of a word or of a run of white space beyond which the fast encoder takes quadratic time or gives up.
LONG = 4096
_GAP = re.compile(rf"\s{{{LONG}}}")


class Encoder:
    """The ids of texts: a fast encoder with the vocabulary at ``path``, and the library that the file is written for where a text has a very long word or gap (ids are equal, tested)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("documents", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)
        self.path, self.n_vocab = path, self.fast.n_vocab

    @functools.cached_property
    def patient(self) -> Tokenizer:
        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def encode(self, text: str) -> list[int]:
        if len(text) >= LONG and (_GAP.search(text) or max(map(len, text.split()), default=0) >= LONG):
            return self.patient.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all")


@functools.lru_cache(2)
def tokenizer(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` tokens."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32`` (and ``ids``), with the writing task and the rank there."""
    spec = "doc_id long, piece int, start long, length long, ids_crc32 long, lane int, rank long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, lane = tokenizer(path), Counter(), TaskContext.get().partitionId()
        for b in batches:
            for c in chunks(b, "text"):
                out: list[list] = [[] for _ in range(8)]
                for doc, text in zip(c.column("doc_id").to_pylist(), c.column("text").to_pylist(), strict=True):
                    ids = np.array([*enc.encode(text), end_id], "<u4")
                    for k, (start, n) in enumerate(cut(len(ids), capacity)):
                        raw = ids[start : start + n].tobytes()
                        for column, x in zip(out, (doc, k, start, n, zlib.crc32(raw), lane, seen[n], raw), strict=True):
                            column.append(x)
                        seen[n] += 1
                yield record_batch(spec, out if with_ids else out[:-1])
            freed()

    return texts(docs).mapInArrow(run, spec)


class Sums:
    """Hash index of the single, pair and triple sums of the lengths that are ``left``.

    A sum's combinations are listed when it is first asked for, best last. A combination whose counts are used up is dropped for good when it is met, as counts only fall.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self.pairs: dict[int, list[int]] = {}
        self.triples: dict[int, list[int]] = {}

    def there(self, low: int, high: int) -> bool:
        return bool(self.left[low] > 0 and self.left[high] > (low == high))

    def single(self, total: int) -> list[int] | None:
        return [total] if self.left[total] else None

    def pair(self, total: int) -> list[int] | None:
        """The two lengths of most equal size that add up to ``total``, under the counts."""
        if total not in self.pairs:
            low = np.arange(1, total // 2 + 1)
            self.pairs[total] = low[(self.left[low] > 0) & (self.left[total - low] > (low == total - low))].tolist()
        lows = self.pairs[total]
        while lows and not self.there(lows[-1], total - lows[-1]):
            lows.pop()
        return [total - lows[-1], lows[-1]] if lows else None

    def triple(self, total: int) -> list[int] | None:
        """The longest length that a pair completes, and that pair."""
        if total not in self.triples:
            self.triples[total] = [a for a in np.flatnonzero(self.left[:total]).tolist() if 3 * a >= total]
        firsts, k = self.triples[total], len(self.triples[total]) - 1
        while k >= 0:
            a = firsts[k]
            if not self.left[a] or not self.pair(total - a):
                del firsts[k]
            else:
                self.left[a] -= 1
                low = next((x for x in reversed(self.pairs[total - a]) if self.there(x, total - a - x)), None)  # of the listed ones few contain ``a``
                self.left[a] += 1
                if low:
                    return [a, total - a - low, low]
            k -= 1
        return None


class Plan:
    """Patterns for counts of lengths; see the module's description."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for n, c in counts.items():
            self.left[n] = c
        self.sums = Sums(self.left)
        self.patterns: list[tuple[list[int], int]] = []

    def run(self) -> list[tuple[list[int], int]]:
        left, sums = self.left, self.sums
        while (here := np.flatnonzero(left)).size:
            pattern = [int(here[-1])]
            left[here[-1]] -= 1
            gap = self.capacity - pattern[0]
            while gap:
                fill = sums.single(gap) or sums.pair(gap) or sums.triple(gap)
                if not fill:
                    fits = np.flatnonzero(left[: gap + 1])
                    if not fits.size:
                        break
                    fill = [int(fits[-1])]
                for n in fill:
                    left[n] -= 1
                pattern += fill
                gap -= sum(fill)
            need = Counter(pattern)
            times = 1 + min(int(left[n]) // k for n, k in need.items())
            for n, k in need.items():
                left[n] -= (times - 1) * k
            self.patterns.append((pattern, times))
        return self.patterns


def segments(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end of ranks, first sequence, pieces of that length in a sequence, offset of the first) for each pattern's lengths."""
    out, ranks, sequence = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for n, k in sorted(Counter(pattern).items(), reverse=True):
            out.append((n, ranks[n], ranks[n] + times * k, sequence, k, offset))
            ranks[n] += times * k
            offset += n * k
        sequence += times
    return out


def place(cut_pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of ``pieces``; reads them several times, so give it a written table."""
    spark = cut_pieces.sparkSession
    lanes = cut_pieces.groupBy("length", "lane").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = written(lanes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lanes")
    counts = {r.length: r.n for r in lanes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    found = segments(Plan(counts, capacity).run())
    # a pattern uses up a length or leaves too few of it for itself, so these are a small multiple of ``capacity`` rows
    at = spark.createDataFrame(found, "at_length long, low long, high long, first_sequence long, each long, first_offset long")
    ranked = small_or_joined(cut_pieces, lanes.select("length", "lane", "before"), ["length", "lane"], "inner").withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(at), (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    return placed.withColumns(
        {"sequence_id": F.col("first_sequence") + F.expr("(rank - low) div each"), "offset": F.col("first_offset") + nth % F.col("each") * F.col("length")}
    ).drop("lane", "rank", "before", *at.columns)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) of every piece."""
    spec = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return place(written(pieces(docs, path, capacity, end_id, with_ids), "pieces"), capacity).select(*spec, *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from ``pack(..., with_ids=True)``: a sequence is bounded, so gathering its pieces is too."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.aggregate(F.transform(parts, lambda p: p.ids), F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))
