"""Top-k retrieval for few queries over many texts, without a table of the texts' words.

Nearly all that a corpus's index of terms holds is there for one number a document, the length of its vector, and nearly all documents are far from any query's best. So terms are counted in
cells (a term's cell holds at least its number of documents, so idfs and lengths come out too small and scores too great), the best of these bounds are scored exactly, with counts of their
documents' terms alone, and a query takes more of them until the best bound that is left is below its k-th score. What is written of a text is the words that are asked for. The result is
that of ``retrieve.best``.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import report as R
from ..functions.text import counted_in, hashes_of_terms, text_or_empty
from ..sources.schemas import defaulted
from ..sources.scratch import scratch, small_or_joined, spread, written
from . import retrieve
from .nearest import greatest, nearest

#: Cells are about so many times the documents, in powers of two, but no more than 2 to ``MOST_BITS``; cells that are sent together.
CELLS, MOST_BITS, PIECE = 64, 24, 1 << 16
#: Tokens whose counts a task keeps; words that are asked for, or whose documents are counted, in one pass.
KEPT, ASKED = 500_000, 4_000_000
#: Documents a query whose bounds are looked at first, and by what that grows.
FIRST, GROWTH = 16, 4
#: Counts in cells are rounded up to powers of this.
STEP = 1.08


def coded(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte each, rounded up."""
    return np.ceil(np.log(np.maximum(counts, 1)) / np.log(STEP)).astype(np.uint8) + (counts > 0)


def decoded(codes: np.ndarray) -> np.ndarray:
    """At least the counts."""
    return np.where(codes > 0, np.ceil(STEP ** (codes.astype(float) - 1) * (1 + 1e-12)), 0.0)


def _rows(cases: DataFrame, id_column: str) -> DataFrame:
    full = defaulted(cases, *retrieve.FIELDS)
    said = F.concat_ws(" ", text_or_empty(F.col("study_description")), text_or_empty(F.col("dictation")))
    headers = F.array_distinct(R.signature(R.parse(F.col("template_content")).fields))
    keys = F.transform(headers, lambda h: F.xxhash64(h)).alias("headers")
    return spread(full.select(F.col(id_column).alias("id"), F.col("row_idx").cast("long").alias("row_idx"), "case_id", "modality", "body_part", keys, F.col("dictation").cast("string").alias("dictation"), F.lower(said).alias("said")))


def _lists(rows: list[tuple[list, list]]) -> pa.Array:
    """``list<struct<word, tf>>`` of lists of both."""
    ends = np.cumsum([0, *(len(words) for words, _ in rows)])
    words, tf = (pa.array(np.concatenate([np.zeros(0, np.int64), *(np.asarray(r[k], np.int64) for r in rows)])) for k in (0, 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([words, tf], ["word", "tf"]))


def _hashes(said: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for t in said:
        words, tf = np.unique(hashes_of_terms(t.as_py()), return_counts=True)
        yield words.astype(np.uint64), tf


class Among:
    """Looks hashes up among some sorted ones, which their first bits nearly place."""

    def __init__(self, hashes: np.ndarray):
        bits = min(22, max(8, len(hashes).bit_length()))
        self.hashes, self.shift = hashes, np.uint64(64 - bits)
        self.starts = np.searchsorted(hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __call__(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``found`` of those that are there, and their places."""
        key = (found >> self.shift).astype(np.int64)
        place, end = self.starts[key], self.starts[key + 1]
        live, there = np.flatnonzero(place < end), []
        while len(live):
            same = self.hashes[place[live]] == found[live]
            there.append(live[same])
            live = live[~same]
            place[live] += 1
            live = live[place[live] < end[live]]
        at = np.concatenate(there) if there else live
        return at, place[at]


WORDS = "array<struct<word: long, tf: long>>"


def digests(rows: DataFrame, tokens: dict[str, int], terms: dict[int, int], bits: int) -> DataFrame:
    """Written: of each document its metadata, its number of tokens (``length``) and the words of it that are asked for, by their numbers; and, in rows without a ``row_idx``, counts of
    documents by token (``word, n``) and by pieces of the cells of all terms (``piece, cells``)."""
    hashes = np.array(sorted(terms, key=lambda h: h % (1 << 64)), np.int64).view(np.uint64)
    numbers = np.array([terms[int(h)] for h in hashes.view(np.int64)], np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((tokens, hashes, numbers))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    piece = min(PIECE, 1 << bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, hashes, numbers = shared.value
        among = Among(hashes)
        cells, seen, known = np.zeros(1 << bits, np.int64), Counter(), None
        names = ["length", "tokens", "terms", "token", "n", "piece", "cells"]
        types = [pa.int32(), (pair := pa.list_(pa.struct([("word", pa.int64()), ("tf", pa.int64())]))), pair, pa.string(), pa.int64(), pa.int64(), pa.binary()]

        def others(rows: int, /, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in known], schema=known)

        for b in batches:
            if known is None:
                known = pa.schema([*(b.schema.field(c) for c in META), *(pa.field(n, t) for n, t in zip(names, types, strict=True))])
            lengths, held, terms = [], [], []
            for t, said in zip(b.column("dictation"), b.column("said"), strict=True):
                bag = counted_in(t.as_py())
                seen.update(bag.keys())
                lengths.append(sum(bag.values()))
                some = [(tokens[w], n) for w, n in bag.items() if w in tokens]
                held.append(([w for w, _ in some], [n for _, n in some]))
                found, tf = np.unique(hashes_of_terms(said.as_py()), return_counts=True)
                np.add.at(cells, (found >> np.uint64(64 - bits)).astype(np.int64), 1)
                mine, place = among(found)
                terms.append((numbers[place], tf[mine]))
            if b.num_rows:
                yield others(b.num_rows, **{c: b.column(c) for c in META}, length=pa.array(lengths, pa.int32()), tokens=_lists(held), terms=_lists(terms))
            if len(seen) > KEPT:
                yield others(len(seen), token=pa.array(list(seen), pa.string()), n=pa.array(list(seen.values()), pa.int64()))
                seen.clear()
        if known is not None:
            yield others(len(seen), token=pa.array(list(seen), pa.string()), n=pa.array(list(seen.values()), pa.int64()))
            for k, at in enumerate(range(0, len(cells), piece)):
                yield others(1, piece=pa.array([k], pa.int64()), cells=pa.array([coded(cells[at : at + piece]).tobytes()], pa.binary()))

    spec = ", ".join(f"{c} {kinds[c]}" for c in META)
    out = rows.select(*META, "dictation", "said").mapInArrow(run, f"{spec}, length int, tokens {WORDS}, terms {WORDS}, token string, n long, piece long, cells binary")
    return written(out.select(*META, "length", "tokens", "terms", F.when(F.col("token").isNotNull(), F.xxhash64("token")).alias("word"), "n", "piece", "cells"), "digest")


META = ["id", "row_idx", "case_id", "modality", "body_part", "headers"]


def cells_of(digest: DataFrame, bits: int) -> np.ndarray:
    """At least the number of documents of each cell's terms, in a byte each. A piece is added up in a task."""
    pieces = digest.filter("piece is not null").select("piece", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, cells in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums[k] = sums.get(k, 0) + decoded(np.frombuffer(cells.as_buffer(), np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([coded(x).tobytes() for x in sums.values()], pa.binary())], ["piece", "cells"])

    out = np.zeros(1 << bits, np.uint8)
    piece = min(PIECE, 1 << bits)
    for r in pieces.repartition("piece").mapInArrow(run, "piece long, cells binary").collect():  # 2 ** MOST_BITS bytes at most
        out[r.piece * piece : (r.piece + 1) * piece] = np.frombuffer(r.cells, np.uint8)
    return out


def least_lengths(rows: DataFrame, cells: np.ndarray, bits: int, n: int) -> DataFrame:
    """``id, norm``: no more than the length of each document's vector."""
    idf = np.log((1 + n) / (1 + np.minimum(decoded(np.arange(256, dtype=np.uint8)), n))) + 1
    shared = rows.sparkSession.sparkContext.broadcast((cells, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, idf = shared.value
        for b in batches:
            norms = [np.sqrt(np.sum((tf * idf[cells[(h >> np.uint64(64 - bits)).astype(np.int64)]]) ** 2)) for h, tf in _hashes(b.column("said"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(norms, pa.float64())], ["id", "norm"])

    return rows.select("id", "said").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, norm double")


def exact_lengths(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """``id, norm`` of some documents: their terms' documents are counted, ``ASKED`` terms a pass."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(h.view(np.int64), tf) for h, tf in _hashes(b.column("said"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), _lists(found)], ["id", "terms"])

    some = rows.join(F.broadcast(ids), "id", "left_semi").select("id", "said").mapInArrow(words, f"id {dict(rows.dtypes)['id']}, terms {WORDS}")
    some = written(some, "terms")
    exploded = retrieve.bags(some, "terms", "term")
    distinct = written(exploded.select("term").distinct(), "asked")
    passes = -(-distinct.count() // ASKED)
    counts = []
    for k in range(passes):
        mine = distinct.filter(F.pmod(F.xxhash64("term"), F.lit(passes)) == k).toArrow().column("term").combine_chunks()  # ``ASKED`` numbers, about
        asked = np.sort(mine.to_numpy(zero_copy_only=False).view(np.uint64))
        shared = rows.sparkSession.sparkContext.broadcast(asked)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, df = shared.value, np.zeros(len(shared.value), np.int64)
            among = Among(asked)
            for b in batches:
                for t in b.column("said"):
                    df[among(hashes_of_terms(t.as_py()))[1]] += 1  # a place that comes twice is counted once
            for at in range(0, len(df), PIECE):
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([df[at : at + PIECE].astype(np.int32).tobytes()], pa.binary())], ["piece", "counts"])

        def total(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for at, some in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    sums[at] = sums.get(at, 0) + np.frombuffer(some.as_buffer(), np.int32).astype(np.int64)
            for at, df in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(shared.value[at : at + PIECE].view(np.int64)), pa.array(df)], ["term", "df"])

        pieces = rows.select("said").mapInArrow(count, "piece long, counts binary")
        counts.append(written(pieces.repartition("piece").mapInArrow(total, "term long, df long"), "counts"))
        shared.destroy()
    if not counts:
        return some.select("id", F.lit(None).cast("double").alias("norm"))
    index = functools.reduce(DataFrame.union, counts)
    weighted = small_or_joined(exploded, index, "term", "inner").withColumn("w", F.col("tf") * retrieve.smooth_idf(F.lit(n), F.col("df")))
    return weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def best_of_texts(queries: DataFrame, cases: DataFrame, id_column: str, k: int = 3) -> DataFrame:
    """``retrieve.best`` of tables of cases, for queries whose words one task can hold; for more, through a written corpus."""
    asked = retrieve.corpus(queries, id_column, hashed=True)
    vocabulary = {c: retrieve.bags(asked, c, "w").select("w", F.xxhash64("w").alias("word")).distinct() for c in ("tokens", "terms")}
    n = cases.count()
    if not n or k < 1 or sum(v.count() for v in vocabulary.values()) > ASKED:
        return retrieve.best(asked, retrieve.corpus(cases, id_column, hashed=True), k)
    bits = min(MOST_BITS, max(8, (n * CELLS).bit_length()))
    with scratch(cases.sparkSession) as kept:
        rows = _rows(cases, id_column)
        words = {c: {r.w: r.word for r in v.collect()} for c, v in vocabulary.items()}  # ``ASKED`` at most
        digest = digests(rows, words["tokens"], words["terms"], bits)
        docs = digest.filter("row_idx is not null").select(*META, "length", "tokens", "terms")
        norms = written(least_lengths(rows, cells_of(digest, bits), bits, n), "norms")
        held = small_or_joined(docs, norms, "id", "left")
        mean = docs.agg(F.avg("length")).first()[0] or 1.0

        def raw(df: F.Column) -> F.Column:
            return F.log(n - df + 0.5) - F.log(df + 0.5)

        counted = digest.filter("word is not null").groupBy("word").agg(F.sum("n").alias("df"))
        least = C.EPSILON * (counted.agg(F.avg(raw(F.col("df")))).first()[0] or 0.0)
        df = {c: retrieve.bags(docs, c, "word").groupBy("word").agg(F.count("*").alias("df")) for c in ("tokens", "terms")}
        idf = {"tokens": F.when(raw(F.col("df")) < 0, least).otherwise(raw(F.col("df"))), "terms": retrieve.smooth_idf(F.lit(n), F.col("df"))}
        index = {c: vocabulary[c].join(df[c], "word").select(F.col("w").alias(c[:-1]), idf[c].alias("idf")) for c in df}
        by_query = retrieve.asked_by_query(asked, retrieve.asked_for(asked, "tokens", "token", index["tokens"], "length"), retrieve.asked_for(asked, "terms", "term", index["terms"]), mean)
        parts, exact = [], None
        for chunk in retrieve.in_chunks(written(by_query, "asked")):
            most = greatest(chunk, docs, mean)
            open_, width, done = chunk, FIRST, []
            while len(open_.ids):
                bounds = written(nearest(open_, most, held, mean, width, False, retrieve.DECIMALS), "bounds")
                ids = written(bounds.select(F.explode("best.doc_id").alias("id")).distinct(), "ids")
                exact = written(exact_lengths(rows, ids, n), "norms")
                some = small_or_joined(docs.join(F.broadcast(ids), "id", "left_semi"), exact, "id", "left")
                found = written(nearest(open_, most, some, mean, k, False, retrieve.DECIMALS), "best")
                # what is left scores no more than the last bound
                last = bounds.select("query_id", F.when(F.size("best") == width, F.get("best.score", F.lit(width - 1))).alias("last"))
                checked = found.join(last, "query_id").withColumn("sure", F.coalesce(F.get("best.rounded", F.lit(k - 1)) > F.col("last") + 2 * 10.0**-retrieve.DECIMALS, F.col("last").isNull()))
                done.append(checked.filter("sure").select(*found.columns))
                left = {r.query_id for r in checked.filter("not sure").select("query_id").collect()}
                at = np.array([i for i, x in enumerate(open_.ids.to_pylist()) if x in left], np.int64)
                open_, most, width = open_.of(at), most[at], width * GROWTH
            parts += done
        if not parts:
            return retrieve.best(asked, retrieve.corpus(cases.limit(0), id_column, hashed=True), k)
        out = functools.reduce(DataFrame.union, [p.select("query_id", F.posexplode("best").alias("rank", "b")) for p in parts])
        return kept(out.select("query_id", (F.col("rank") + 1).alias("rank"), "b.doc_id", "b.score"), "best")
