"""The best k of all pairs of queries and documents, block against block: no pair is ever a row.

Queries are cut into chunks of bounded size, each broadcast in turn; a pass reads the documents where they lie and scores some of them at a time against some of the chunk: words that many
of both have as a product of dense matrices, others one by one. Both are put in order by the most frequent word that they have, so that what is scored together is alike (has a language, say) and
has few such words, but most of its common ones. A task keeps the best k of each query of the chunk and sends them at its end. So shuffles and disk follow the number of queries times tasks, and
memory the size of a chunk and a block, whatever the number of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C

#: Words and rows of a chunk of queries, about; queries and documents scored together; so many times as many documents are put in order; columns that are multiplied densely at a time;
#: products of single entries at a time.
WORDS, ROWS, ROWS_TOGETHER, TOGETHER, ORDERED, COLUMNS, PRODUCTS = 2_000_000, 8_192, 1_024, 1_024, 8, 1_024, 1 << 20
#: A word that this share of a block's pairs hold is multiplied densely.
DENSE = 1 / 1000
#: Columns of a block whose greatest score stands for them where a bound of the k-th best is sought.
RUN = 32


class Asked:
    """The words of a chunk's queries as a sparse matrix, in blocks of rows, by word within each."""

    def __init__(self, row: np.ndarray, words: np.ndarray, value: np.ndarray, rows: int):
        self.words, column = np.unique(words, return_inverse=True)
        self.rows, self.together, self.dense, self.columns, self.products = rows, ROWS_TOGETHER, DENSE, COLUMNS, PRODUCTS
        order = np.lexsort((column, row // self.together))
        self.row, self.column, self.value = row[order].astype(np.int32), column[order].astype(np.int32), value[order]

    def ready(self, factor: np.ndarray | None = None) -> Asked:
        """With what a task makes of it: blocks' columns and the words' places and ranks by frequency. Rows are multiplied by ``factor``."""
        blocks = -(-self.rows // self.together)
        ends = np.searchsorted(self.row // self.together, np.arange(blocks + 1))
        self.starts = [np.searchsorted(self.column[a:b], np.arange(len(self.words) + 1)).astype(np.int32) + np.int32(a) for a, b in zip(ends, ends[1:], strict=False)]
        self.sizes = [np.diff(x) for x in self.starts]
        self.rank = _ranks(self.column, len(self.words))
        self.index = pd.Index(self.words)
        if factor is not None:
            self.value = self.value * factor[self.row]
        return self

    def met(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows with so many ``words`` each: places of the words that are asked for, their rows and columns."""
        column = self.index.get_indexer(words)
        at = np.flatnonzero(column >= 0)
        return at, np.repeat(np.arange(len(sizes)), sizes)[at], column[at]

    def add(self, out: np.ndarray, block: int, documents: Entries) -> list[tuple[np.ndarray, np.ndarray]]:
        """Adds the products of a block of the queries with documents, but for those of matrices, which it gives."""
        first, n = block * self.together, documents.n
        rest, flat, matrices = documents, out.reshape(-1), []
        if len(documents.column) and self.dense <= 1:
            chosen = np.flatnonzero(self.sizes[block] * documents.sizes > self.dense * out.size)
            for at in range(0, len(chosen), self.columns):
                some = chosen[at : at + self.columns]
                place = np.full(len(self.words), -1, np.int32)
                place[some] = np.arange(len(some), dtype=np.int32)
                left, right = np.zeros((len(out), len(some))), np.zeros((n, len(some)))
                entries = _runs(self.starts[block][some].astype(np.int64), self.sizes[block][some])
                left[self.row[entries] - first, np.repeat(np.arange(len(some)), self.sizes[block][some])] = self.value[entries]
                to = place[rest.column]
                mine = np.flatnonzero(to >= 0)
                right[rest.row[mine], to[mine]] = rest.value[mine]
                matrices.append((left, right))
                rest = rest.only(np.flatnonzero(to < 0))
        for cell, product in self._single(block, rest):
            np.add.at(flat, cell, product)
        return matrices

    def cells(self, block: int, documents: Entries) -> np.ndarray:
        """Cells of a block that share a word, each as often as it shares one."""
        return np.concatenate([np.zeros(0, np.int64), *(cell for cell, _ in self._single(block, documents))])

    def _single(self, block: int, documents: Entries) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = self.sizes[block][documents.column]
        some = np.flatnonzero(size)
        row, value, first, size = documents.row[some], documents.value[some], self.starts[block][documents.column[some]].astype(np.int64), size[some].astype(np.int64)
        ends = np.cumsum(size)
        at = done = 0
        while at < len(size):
            stop = max(at + 1, int(np.searchsorted(ends, done + self.products, "right")))
            part = size[at:stop]
            entries = _runs(first[at:stop], part)
            yield (self.row[entries] - block * self.together).astype(np.int64) * documents.n + np.repeat(row[at:stop], part), self.value[entries] * np.repeat(value[at:stop], part)
            at, done = stop, int(ends[stop - 1])


class Dense:
    """The sum of products of matrices: about in single precision, and a bound of what that is off in each row; exactly where it is asked for."""

    def __init__(self, shape: tuple[int, int]):
        self.matrices, self.about, self.off = [], np.zeros(shape, np.float32), np.zeros(shape[0])

    def add(self, matrices: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.matrices += matrices
        for left, right in matrices:
            self.about += left.astype(np.float32) @ right.astype(np.float32).T
            self.off += (left.shape[1] + 16) * 2.0**-23 * (np.abs(left) @ np.abs(right).max(axis=0))

    def at(self, q: np.ndarray, d: np.ndarray) -> np.ndarray:
        out = np.zeros(len(q))
        for at in range(0, len(q), 4096):
            some = slice(at, at + 4096)
            for left, right in self.matrices:
                out[some] += np.einsum("ij,ij->i", left[q[some]], right[d[some]])
        return out

    def with_others(self, others: np.ndarray) -> np.ndarray:
        """About the sum with what isn't multiplied densely."""
        return np.add(self.about, others, dtype=np.float32, casting="same_kind")

    def rows(self, some: np.ndarray) -> np.ndarray:
        return sum((left[some] @ right.T for left, right in self.matrices), np.zeros((len(some), self.about.shape[1])))


class Entries:
    """Some documents' entries: rows, columns that are places in an ``Asked``'s words, and values; and, of the whole, how many a column has."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, words: int = 0):
        self.row, self.column, self.value, self.n = row, column, value, n
        self.sizes = np.bincount(column, minlength=words) if words else None

    def only(self, at: np.ndarray) -> Entries:
        return Entries(self.row[at], self.column[at], self.value[at], self.n)


def _runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers from each of ``first`` on, so many of each."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def _ranks(column: np.ndarray, words: int) -> np.ndarray:
    """Of each word its place by frequency."""
    rank = np.empty(words, np.int32)
    rank[np.argsort(-np.bincount(column, minlength=words), kind="stable")] = np.arange(words, dtype=np.int32)
    return rank


def _alike(row: np.ndarray, rank: np.ndarray, rows: int) -> np.ndarray:
    """An order of rows by the most frequent word of each."""
    first = np.full(rows, np.iinfo(np.int32).max, np.int32)
    np.minimum.at(first, row, rank)
    return np.argsort(first, kind="stable")


def in_order(queries: pa.Table) -> pa.Table:
    """Rows of a chunk such that neighbours are alike."""
    flat, sizes = _flat(queries.column("tokens").combine_chunks())
    words, column = np.unique(_numbers(flat.field("word"), np.int64), return_inverse=True)
    return queries.take(pa.array(_alike(np.repeat(np.arange(len(sizes)), sizes), _ranks(column, len(words))[column], queries.num_rows)))


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A column's lists one after the other, and their sizes."""
    return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _numbers(values: pa.Array, kind: type) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _codes(values: pa.Array, among: pa.Array, missing: int) -> np.ndarray:
    return pc.fill_null(pc.index_in(values, value_set=among, skip_nulls=True), missing).to_numpy(zero_copy_only=False)


def _together(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The rows, ``n`` at a time."""
    held, rows = [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            held.append(b.slice(at, n - rows))
            at, rows = at + held[-1].num_rows, rows + held[-1].num_rows
            if rows == n:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Chunk:
    """Some queries (``id, case_id, modality, body_part, headers, tokens<word, value>, terms<word, value>, own``), as what documents are scored against."""

    def __init__(self, queries: pa.Table):
        self.queries = queries
        self.ids, rows = queries.column("id").combine_chunks(), queries.num_rows

        def asked(name: str) -> tuple[Asked, np.ndarray]:
            flat, sizes = _flat(queries.column(name).combine_chunks())
            words, value = (flat, np.ones(len(flat))) if name == "headers" else (flat.field("word"), _numbers(flat.field("value"), float))
            return Asked(np.repeat(np.arange(rows), sizes), _numbers(words, np.int64), value, rows), sizes

        self.tokens, self.terms, (self.keys, self.n_q) = asked("tokens")[0], asked("terms")[0], asked("headers")
        meta = {c: queries.column(c).combine_chunks().dictionary_encode() for c in ("case_id", "modality", "body_part")}
        self.known = {c: (x.dictionary, pc.fill_null(x.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)) for c, x in meta.items()}
        self.blank = _numbers(pc.fill_null(pc.equal(queries.column("case_id").combine_chunks(), ""), False), bool)
        codes = self.known["case_id"][1]
        named = np.flatnonzero((codes >= 0) & ~self.blank)
        self.cases = Asked(named, codes[named], np.ones(len(named)), rows)
        self.blocks = [slice(a, min(rows, a + ROWS_TOGETHER)) for a in range(0, rows, ROWS_TOGETHER)]
        self.own = _numbers(queries.column("own").combine_chunks().fill_null(0.0), float)
        self.together, self.ordered, self.is_ready = TOGETHER, ORDERED, False

    def of(self, rows: np.ndarray) -> Chunk:
        """Some of its queries."""
        return Chunk(self.queries.take(pa.array(rows)))

    def __getstate__(self) -> dict:
        return {**self.__dict__, "queries": None}  # tasks have what is made of it

    def ready(self, used: np.ndarray | None = None) -> Chunk:
        """In a task, once in its process; BM25 scores are divided by ``used`` and scores have their shares, if that is given."""
        if self.is_ready:
            return self
        self.is_ready = True
        self.tokens.ready(None if used is None else C.BM25_SHARE / np.where(used > 0, used, 1.0))
        self.terms.ready(None if used is None else np.full(len(used), C.TFIDF_SHARE))
        self.keys.ready()
        self.cases.ready()
        return self

    def documents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents that are scored together, neighbours alike."""
        for b in _together(batches, self.together * self.ordered):
            flat, sizes = _flat(b.column("tokens"))
            _, row, column = self.tokens.met(_numbers(flat.field("word"), np.int64), sizes)
            b = b.take(pa.array(_alike(row, self.tokens.rank[column], b.num_rows)))
            for at in range(0, b.num_rows, self.together):
                yield b.slice(at, self.together)

    def bm25(self, b: pa.RecordBatch, mean: float) -> Entries:
        flat, sizes = _flat(b.column("tokens"))
        at, row, column = self.tokens.met(_numbers(flat.field("word"), np.int64), sizes)
        tf, length = _numbers(flat.field("tf"), float)[at], _numbers(b.column("length"), float)[row]
        return Entries(row, column, tf * (C.K1 + 1) / (tf + C.K1 * (1 - C.B + C.B * length / mean)), b.num_rows, len(self.tokens.words))

    def cosine(self, b: pa.RecordBatch) -> Entries:
        flat, sizes = _flat(b.column("terms"))
        at, row, column = self.terms.met(_numbers(flat.field("word"), np.int64), sizes)
        norm = _numbers(pc.fill_null(b.column("norm"), 1.0), float)
        return Entries(row, column, _numbers(flat.field("tf"), float)[at] / norm[row], b.num_rows, len(self.terms.words))

    def headers(self, b: pa.RecordBatch) -> tuple[Entries, np.ndarray]:
        flat, n_d = _flat(b.column("headers"))
        at, row, column = self.keys.met(_numbers(flat, np.int64), n_d)
        return Entries(row, column, np.ones(len(at)), b.num_rows), n_d

    def factors(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Of each query the row, and the rows, of factors for the documents: there is one for each modality and body part that queries have."""
        pairs, kind = np.unique(np.stack([self.known["modality"][1], self.known["body_part"][1]]), axis=1, return_inverse=True)
        same = [pairs[i][:, None] == _codes(b.column(c), self.known[c][0], -2) for i, c in enumerate(("modality", "body_part"))]
        return kind.reshape(-1), np.where(same[0], *C.MODALITY_FACTORS) * np.where(same[1], *C.BODY_PART_FACTORS)


class Best:
    """The best k of each query so far, by score rounded and then by row."""

    def __init__(self, rows: int, k: int, decimals: int):
        self.k, self.decimals = k, decimals
        self.rounded, self.score = np.full((rows, k), -1.0), np.zeros((rows, k))
        self.row_idx, self.document = np.zeros((rows, k), np.int64), np.zeros((rows, k), np.int64)

    def add(self, rows: slice, score: np.ndarray, off: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], np.ndarray], row_idx: np.ndarray, first: int) -> None:
        """Scores of a block's queries with documents, numbered from ``first``, that are off by ``off`` at most; those that are above 0 when they are ``exact`` count."""
        runs, least = score.shape[1] // RUN, self.rounded[rows, -1]
        if runs >= 2 * self.k:  # k of the runs' greatest are k scores
            greatest = np.maximum.reduce(score[:, : runs * RUN].reshape(len(score), RUN, runs), axis=1)
            least = np.maximum(least, np.partition(greatest, -self.k, axis=1)[:, -self.k] - off)
        floor = np.maximum(least, 0) - off - 2 * 10.0**-self.decimals
        at = np.flatnonzero(score >= np.nextafter(floor.astype(np.float32), np.float32(-1))[:, None])
        at = at[score.reshape(-1)[at] > -1]
        q, d = np.divmod(at, score.shape[1])
        found = exact(q, d)
        mine = np.flatnonzero(found > 0)
        q, d, found = q[mine], d[mine], found[mine]
        touched = np.unique(q)
        if not len(touched):
            return
        held = touched + rows.start
        q = np.concatenate([np.repeat(touched, self.k), q])
        columns = [
            np.concatenate([x[held].reshape(-1), y])
            for x, y in ((self.rounded, np.round(found, self.decimals)), (self.row_idx, row_idx[d]), (self.score, found), (self.document, d + first))
        ]
        order = np.lexsort((-columns[1], -columns[0], q))
        start = np.searchsorted(q[order], touched)
        chosen = order[(start[:, None] + np.arange(self.k)).reshape(-1)]
        for to, x in zip((self.rounded, self.row_idx, self.score, self.document), columns, strict=True):
            to[held] = x[chosen].reshape(-1, self.k)


def greatest(chunk: Chunk, docs: DataFrame, mean: float) -> np.ndarray:
    """The greatest BM25 score over all documents of each query of a chunk, 0 at least."""
    shared = docs.sparkSession.sparkContext.broadcast(chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = shared.value.ready()
        most = np.zeros(len(chunk.ids))
        for b in chunk.documents(batches):
            documents = chunk.bm25(b, mean)
            for j, rows in enumerate(chunk.blocks):
                score = np.zeros((rows.stop - rows.start, b.num_rows))
                for left, right in chunk.tokens.add(score, j, documents):
                    score += left @ right.T
                most[rows] = np.maximum(most[rows], score.max(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(most))), pa.array(most)], ["at", "most"])

    found = docs.select("tokens", "length").mapInArrow(run, "at long, most double").groupBy("at").agg(F.max("most").alias("most")).collect()  # a row a query of the chunk
    shared.destroy()
    out = np.zeros(len(chunk.ids))
    for r in found:
        out[r["at"]] = r["most"]
    return out


def nearest(chunk: Chunk, used: np.ndarray, docs: DataFrame, mean: float, k: int, exclude_self: bool, decimals: int) -> DataFrame:
    """``query_id, used, most, best``: of each query of a chunk the best ``k`` documents that score above 0, best first (``rounded, row_idx, doc_id, score``), where its greatest BM25 score is
    taken to be ``used``, and the greatest that was met.

    Documents have their vector's length as ``norm``; header keys and words are numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast((chunk, used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, used = shared.value
        chunk.ready(used)
        seen, best, ids, first = np.zeros(len(used)), Best(len(used), k, decimals), [], 0
        for b in chunk.documents(batches):
            n, row_idx = b.num_rows, _numbers(b.column("row_idx"), np.int64)
            tokens, terms, (keys, n_d), (kind, factors) = chunk.bm25(b, mean), chunk.cosine(b), chunk.headers(b), chunk.factors(b)
            named, case = _codes(b.column("case_id"), chunk.known["case_id"][0], -1), np.flatnonzero(b.column("case_id").is_null().to_numpy(zero_copy_only=False))
            at = np.flatnonzero(named >= 0)
            at = at[np.isin(named[at], chunk.cases.words)] if exclude_self else at[:0]
            same = Entries(at, np.searchsorted(chunk.cases.words, named[at]), np.ones(len(at)), n)
            for j, rows in enumerate(chunk.blocks):
                score = np.zeros((rows.stop - rows.start, n))
                dense = Dense(score.shape)
                dense.add(chunk.tokens.add(score, j, tokens))
                about = dense.with_others(score).max(axis=1).astype(float)
                near = np.flatnonzero(about + dense.off >= C.BM25_SHARE * (1 - 1e-6))  # where ``used`` may be reached
                about[near] = (score[near] + dense.rows(near)).max(axis=1)
                seen[rows] = np.maximum(seen[rows], about)
                dense.add(chunk.terms.add(score, j, terms))
                flat, cells = score.reshape(-1), chunk.keys.cells(j, keys)
                if len(cells):
                    cell, both = np.unique(cells, return_counts=True)
                    flat[cell] += C.HEADER_SHARE * both / (chunk.n_q[rows][cell // n] + n_d[cell % n] - both)

                def exact(q: np.ndarray, d: np.ndarray, score=score, dense=dense, kind=kind[rows], factors=factors) -> np.ndarray:
                    return (score[q, d] + dense.at(q, d)) * factors[kind[q], d]

                about = dense.with_others(score)
                about *= factors.astype(np.float32)[kind[rows]]
                if exclude_self:
                    about.reshape(-1)[chunk.cases.cells(j, same)] = -1
                    about[chunk.known["case_id"][1][rows] < 0] = -1
                    about[np.ix_(np.flatnonzero(~chunk.blank[rows]), case)] = -1
                best.add(rows, about, 2 * dense.off + 1e-6, exact, row_idx, first)
            ids.append(b.column("id"))
            first += n
        seen *= np.where(used > 0, used, 1.0) / C.BM25_SHARE
        names = ["query_id", "used", "most", "doc_id", "row_idx", "score", "rounded"]
        if ids:
            at, rank = np.nonzero(best.rounded >= 0)
            places = pa.array(best.document[at, rank])
            columns = [chunk.ids.take(pa.array(at)), pa.array(used[at]), pa.array(seen[at]), pa.concat_arrays(ids).take(places), *(pa.array(x[at, rank]) for x in (best.row_idx, best.score, best.rounded))]
            yield pa.RecordBatch.from_arrays(columns, names)
            nothing = [pa.nulls(len(seen), x.type) for x in columns[3:]]
            yield pa.RecordBatch.from_arrays([chunk.ids, pa.array(used), pa.array(seen), *nothing], names)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    asked_kind = "string" if pa.types.is_string(chunk.ids.type) or pa.types.is_large_string(chunk.ids.type) else "long"
    held = docs.select("id", F.col("row_idx").cast("long"), "case_id", "modality", "body_part", "headers", "tokens", "length", "terms", "norm")
    rows = held.mapInArrow(run, f"query_id {asked_kind}, used double, most double, doc_id {kinds['id']}, row_idx long, score double, rounded double")
    found = F.collect_list(F.when(F.col("rounded").isNotNull(), F.struct("rounded", "row_idx", "doc_id", "score")))
    return rows.groupBy("query_id").agg(F.max("used").alias("used"), F.max("most").alias("most"), F.slice(F.reverse(F.array_sort(found)), 1, k).alias("best"))
