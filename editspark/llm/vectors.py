"""Near-duplicate vectors by product quantisation, links confirmed by exact cosines.

Equal vectors of a label are one class (``item``), grouped by their values. Coarse centroids and codebooks of residuals are fitted on a bounded sample
of classes; every class is indexed. A class is stored in the inverted list of its nearest centroid, its home, as one code a subspace of ``SUB`` components,
and asks the lists of its ``probes`` nearest centroids. A list's task looks distances up in a table of products of the asking vector with the
codewords (the asking vector itself travels in eight bits a component). A vector differs from its code by a known ``error``, and from its
eight-bit form by a known ``shift``, so a product of at least ``LEAST - error - shift`` is looked at further and no pair of a list is lost to quantisation.
Members of a list that have such a pair, and only those, get their full vectors; cosines in double precision decide.

A list's task gives counts and a spanning forest, never pairs. Each pair counts once: in its common home, or else in the list of the lesser home of those where both are
present. Lists of over ``UNIT`` rows are dealt into blocks of stored and of asking rows that meet block against block in tasks of bounded size; equal vectors are
one row there, but a list of many different vectors that are all alike costs the square of its rows in products, as its count of links does.

``probes`` is the least number by which ``FOUND`` of the sample's pairs at the threshold are found; those pairs are made by turning sampled vectors
towards each other and in random directions by the threshold's angle. The number of lists follows the number of classes up to ``MOST_LISTS``.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label or ``vec_id``, link with nothing; vectors of
different lengths don't link (for quantisation shorter ones are padded with zeros); rows that repeat an id are vectors of their own;
a row without an id is its own component (null) and kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import HOT_ROWS
from .common import hot_joined, record_batch, scratch, small_batches, small_or_joined, spread, thinned, written
from .components import components

LEAST = 0.93
#: Sample that the index is fitted on: rows and components at most.
MOST_SAMPLE, MOST_VALUES = 16_384, 1 << 23
#: Classes of a label that a list is made for; lists at most; share of the pairs at the threshold that the probes must find.
PER_LIST, MOST_LISTS, FOUND = 256, 4_096, 0.99
#: Components of a subspace and codewords of it.
SUB, WORDS = 4, 256
#: Rows of a side of a unit, about; asking rows that are looked up at a time.
UNIT, ASKING = 2_048, 64
ROUNDS = 6


def directed(m: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled by their largest component first, so that squares neither overflow nor vanish."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


ROWS = "vec_id long, key binary, space binary, dim int, vector binary"


def rows_of(vectors: DataFrame) -> DataFrame:
    """``vec_id, key, space, dim, vector``: the digests of a vector with its label and of label and length (null if it takes no part), and its values as bytes."""
    small_batches(vectors.sparkSession)
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for vec, label, said in zip(*(b.column(c) for c in ("vec_id", "label", "embedding")), strict=True):
                vec, label = vec.as_py(), label.as_py()
                v = said.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0 if said.is_valid else np.zeros(0)  # no negative zero
                if vec is None or label is None or not len(v) or not np.isfinite(v).all() or not v.any():
                    out.append((vec, None, None, None, None))
                    continue
                with np.errstate(over="ignore"):
                    short = v.astype("<f4")
                stored = (short if (short == v).all() else v.astype("<f8")).tobytes()  # exact either way
                space = xxhash.xxh3_128_digest(f"{len(v)} {label}".encode("utf-8", "surrogatepass"))
                out.append((vec, xxhash.xxh3_128_digest(space + stored), space, len(v), stored))
            yield record_batch(ROWS, zip(*out, strict=True) if out else [[]] * 5)

    return spread(base).mapInArrow(run, ROWS)


def loaded(vector: list[bytes], dim: list[int]) -> list[np.ndarray]:
    return [np.frombuffer(v, "<f4" if len(v) == 4 * d else "<f8").astype(np.float64) for v, d in zip(vector, dim, strict=True)]


def padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for k, v in enumerate(rows):
        out[k, : len(v)] = v
    return out


def means(x: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Centroids of ``x`` by a few rounds of k-means."""
    draw = np.random.default_rng(seed)
    c = x[draw.permutation(len(x))[:count]].copy()
    for _ in range(ROUNDS):
        near = nearest(x, c)
        size = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(size)
        c[full] = np.add.reduceat(x[order], (np.cumsum(size) - size)[full], axis=0) / size[full, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[k : k + 4096] @ c.T - half, axis=1) for k in range(0, len(x), 4096)])


@dataclass
class Quantiser:
    centroids: np.ndarray
    books: np.ndarray  # subspace, word, component
    probes: int

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def lists(self, x: np.ndarray, most: int) -> np.ndarray:
        """The nearest lists of each row, nearest first."""
        near = x @ self.centroids.T - (self.centroids**2).sum(axis=1) / 2
        return np.argsort(-near, axis=1, kind="stable")[:, :most].astype(np.int32)

    def codes(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A word's number for each subspace of the residual, and the length of what it leaves out."""
        left = (x - self.centroids[home]).reshape(len(x), -1, SUB)
        code = np.stack([nearest(left[:, m], words) for m, words in enumerate(self.books)], axis=1)
        rest = left - self.books[np.arange(len(self.books)), code]
        return code.astype(np.uint8), np.sqrt((rest**2).sum(axis=(1, 2)))

    def looked_up(self, asking: np.ndarray, of_list: int, codes: np.ndarray) -> np.ndarray:
        """Products of asking vectors with what the codes of a list stand for, from a table of products with all words."""
        table = np.matmul(asking.reshape(len(asking), -1, SUB).transpose(1, 0, 2), self.books.transpose(0, 2, 1))
        out = np.repeat((asking @ self.centroids[of_list])[:, None], len(codes), axis=1)
        for m, of_words in enumerate(table):
            out += of_words[:, codes[:, m]]
        return out


def fit(sample: np.ndarray, per_label: float) -> Quantiser:
    """From rows of length 1, and the number of classes that share a label with a class on average."""
    sample = sample.astype(np.float32)
    count = int(np.clip(per_label / PER_LIST, 1, min(MOST_LISTS, max(1, len(sample) // 4))))
    found = Quantiser(means(sample, count, 1), np.zeros((0, 0, SUB), np.float32), 1)
    left = (sample - found.centroids[nearest(sample, found.centroids)]).reshape(len(sample), -1, SUB)
    found.books = np.stack([means(left[:, m], min(WORDS, len(sample)), 2 + m) for m in range(left.shape[1])])
    found.probes = sufficient(found, sample)
    return found


def sufficient(index: Quantiser, sample: np.ndarray) -> int:
    """The probes by which ``FOUND`` of made pairs at the threshold are found from one of their sides."""
    draw = np.random.default_rng(0)
    some = sample[draw.permutation(len(sample))[:1_024]]
    need = []
    for towards in (some[draw.permutation(len(some))], draw.standard_normal(some.shape)):
        side = towards - (towards * some).sum(axis=1, keepdims=True) * some
        far = np.sqrt((side**2).sum(axis=1))
        side, base = side[far > 1e-6] / far[far > 1e-6, None], some[far > 1e-6]
        if not len(side):
            continue
        a, b = (index.lists(x.astype(np.float32), len(index.centroids)) for x in (base, LEAST * base + np.sqrt(1 - LEAST**2) * side))
        need.append(np.minimum((a == b[:, :1]).argmax(axis=1), (b == a[:, :1]).argmax(axis=1)) + 1)
    return max((int(np.quantile(x, FOUND, method="higher")) for x in need), default=1)


def fitted(classes: DataFrame) -> Quantiser | None:
    """The index's quantiser from a sample of the classes by hash; None without any."""
    at = classes.groupBy("space").agg(F.count("*").cast("double").alias("n")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("square")).first()
    if not at.n:
        return None
    width = classes.agg(F.max("dim")).first()[0]
    most = int(np.clip(MOST_VALUES // width, 1, MOST_SAMPLE))
    some = classes.filter(thinned(F.col("key"), most, F.lit(at.n))).orderBy(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 32)), "key").limit(most).select("vector", "dim").toArrow()
    return fit(directed(padded(loaded(some["vector"].to_pylist(), some["dim"].to_pylist()), -(-width // SUB) * SUB)), at.square / at.n)


INDEXED = "item long, space binary, probes array<int>, code binary, error float, eighths binary, scale float, shift float"
#: Above the rounding of single precision.
SLACK = 1e-4


def indexed(classes: DataFrame, index: Quantiser) -> DataFrame:
    """Of every class: its lists, home first; its code with its error; and its eight-bit form with its scale and shift."""
    shared = classes.sparkSession.sparkContext.broadcast(index)  # at most MOST_LISTS centroids and WORDS words a subspace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                b = whole.slice(k, 1024)
                x = directed(padded(loaded(b.column("vector").to_pylist(), b.column("dim").to_pylist()), index.width))
                at = index.lists(x.astype(np.float32), index.probes)
                code, error = index.codes(x.astype(np.float32), at[:, 0])
                scale = np.abs(x).max(axis=1) / 127
                eighths = np.rint(x / scale[:, None]).astype(np.int8)
                shift = np.sqrt(((x - eighths * scale[:, None]) ** 2).sum(axis=1))
                lists = pa.ListArray.from_arrays(np.arange(0, at.size + 1, at.shape[1], dtype=np.int32), at.ravel())
                packed = [[r.tobytes() for r in m] for m in (code, eighths)]
                columns = [b.column("item"), b.column("space"), lists, packed[0], (error + SLACK).astype(np.float32), packed[1], scale.astype(np.float32), (shift + SLACK).astype(np.float32)]
                arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, ["item", "space", "probes", "code", "error", "eighths", "scale", "shift"])

    return classes.select("item", "space", "dim", "vector").mapInArrow(run, INDEXED)


KEYS = ["unit", "space", "list", "block", "ask"]
#: Whether a row is stored in its unit, asks there, or both.
STORED, ASKS = 1, 2


def dealt(index: DataFrame) -> DataFrame:
    """The rows of ``indexed`` in each of their lists and there in units: ``KEYS``, ``role``, the home and the rest, codes at home only."""
    each = index.select("*", F.posexplode("probes").alias("at", "list"))
    home = F.col("at") == 0
    sizes = index.select("space", F.posexplode("probes").alias("at", "list")).groupBy("space", "list").agg(F.count("*").alias("all"), F.count_if(home).alias("homes")).filter(F.col("all") > 2 * UNIT)
    large = written(sizes.select("space", "list", F.ceil(F.col("homes") / UNIT).alias("blocks"), F.ceil(F.col("all") / UNIT).alias("asks")), "large")
    each = small_or_joined(each, large, ["space", "list"], "left")  # a row for over 2 * UNIT rows of the index
    number = lambda salt, n: F.pmod(F.xxhash64("item", F.lit(salt)), n)
    cell = lambda block, ask, role: F.struct(block.cast("long").alias("block"), ask.cast("long").alias("ask"), F.lit(role).alias("role"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    stored = F.transform(upto(F.when(home, F.col("asks")).otherwise(F.lit(0))), lambda j: cell(number("block", F.col("blocks")), j, STORED))
    asking = F.transform(upto(F.col("blocks")), lambda i: cell(i, number("ask", F.col("asks")), ASKS))
    one = F.when(home, F.array(cell(F.lit(0), F.lit(0), STORED | ASKS))).otherwise(F.array(cell(F.lit(0), F.lit(0), ASKS)))
    cells = F.explode(F.when(F.col("asks").isNull(), one).otherwise(F.concat(stored, asking))).alias("cell")
    only = lambda c, at: F.when(at, F.col(c)).alias(c)
    rows = each.select("space", "list", "item", F.col("probes")[0].alias("home"), only("probes", home), "code", "error", "eighths", "scale", "shift", cells)
    stores, asks = F.col("cell.role").bitwiseAND(STORED) > 0, F.col("cell.role").bitwiseAND(ASKS) > 0
    unit = F.xxhash64("space", "list", "cell.block", "cell.ask").alias("unit")
    return rows.select(unit, "space", "list", "cell.block", "cell.ask", "cell.role", "item", "home", "probes", only("code", stores), only("error", stores), only("eighths", asks), only("scale", asks), only("shift", asks))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each unit, of a table sorted by ``KEYS``; a unit's rows are bounded."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for k in KEYS:
            c = b.column(k)
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        new[0] = bool(held) and any(held[-1].column(k)[-1] != b.column(k)[0] for k in KEYS)
        at = 0
        for k in [*np.flatnonzero(new).tolist(), b.num_rows]:
            if k == at and held:  # the batch begins with a new unit
                yield pa.Table.from_batches(held)
                held = []
            elif k > at:
                held.append(b.slice(at, k - at))
                if k < b.num_rows:
                    yield pa.Table.from_batches(held)
                    held = []
            at = k
    if held:
        yield pa.Table.from_batches(held)


def grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS)


def countable(item: np.ndarray, asking: np.ndarray, home: np.ndarray, of_list: int, probes: np.ndarray) -> np.ndarray:
    """Which pairs of asking and stored rows count in this list: at a common home the one with the lesser asking item, else those that the asking row's home doesn't count."""
    same = (home == of_list)[:, None] & (asking[:, None] < item)
    there = (probes[None] == home[:, None, None]).any(axis=2)  # the stored row asks the list of the asking row's home
    return same | (home != of_list)[:, None] & ~((home < of_list)[:, None] & there)


def _side(t: pa.Table, role: int) -> pa.Table:
    return t.filter(pa.array(t["role"].to_numpy() & role > 0))


def _homes(stored: pa.Table) -> np.ndarray:
    return np.array(stored["probes"].to_pylist(), np.int32).reshape(stored.num_rows, -1)


MEMBERS = "unit long, space binary, list int, block long, ask long, role int, item long, home int, probes array<int>"


def promising(index: DataFrame, quantiser: Quantiser) -> DataFrame:
    """The rows of each unit that have a partner there by looked-up products."""
    shared = index.sparkSession.sparkContext.broadcast(quantiser)
    names = [f.split()[0] for f in MEMBERS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser = shared.value
        for t in runs(batches):
            stored, asks = _side(t, STORED), _side(t, ASKS)
            if not stored.num_rows or not asks.num_rows:
                continue
            of_list, probes = t["list"][0].as_py(), _homes(stored)
            codes = np.frombuffer(b"".join(stored["code"].to_pylist()), np.uint8).reshape(stored.num_rows, -1)
            eighths = np.frombuffer(b"".join(asks["eighths"].to_pylist()), np.int8).reshape(asks.num_rows, -1)
            item, error = stored["item"].to_numpy(), stored["error"].to_numpy()
            asking, home, scale, shift = (asks[c].to_numpy() for c in ("item", "home", "scale", "shift"))
            met, meets = np.zeros(len(item), bool), np.zeros(len(asking), bool)
            for k in range(0, len(asking), ASKING):
                some = slice(k, k + ASKING)
                near = quantiser.looked_up(eighths[some] * scale[some, None], of_list, codes) >= LEAST - error - shift[some, None]
                if near.any():
                    near &= countable(item, asking[some], home[some], of_list, probes)
                    met |= near.any(axis=0)
                    meets[some] = near.any(axis=1)
            chosen = np.unique(np.concatenate([item[met], asking[meets]]))
            if len(chosen):
                yield from t.filter(pc.is_in(t["item"], pa.array(chosen))).select(names).combine_chunks().to_batches()

    return grouped(dealt(index)).mapInArrow(run, MEMBERS)


FOREST = "a long, b long, n long"


def counted(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b, n``: links of a class with other classes' vectors in a unit (``b`` null), and a spanning forest of each unit's links (``n`` null), by exact cosines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches):
            stored, asks = _side(t, STORED), _side(t, ASKS)
            if not stored.num_rows or not asks.num_rows:
                continue
            sides = [directed(np.array(loaded(s["vector"].to_pylist(), s["dim"].to_pylist()))) for s in (stored, asks)]
            item, asking, copies, asked = stored["item"].to_numpy(), asks["item"].to_numpy(), stored["copies"].to_numpy(), asks["copies"].to_numpy()
            probes, of_list, home = _homes(stored), t["list"][0].as_py(), asks["home"].to_numpy()
            ids, number = np.unique(np.concatenate([item, asking]), return_inverse=True)
            at, from_ = number[: len(item)], number[len(item) :]
            total, group, forest = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
            for k in range(0, len(asking), ASKING):
                some = slice(k, k + ASKING)
                linked = (sides[1][some] @ sides[0].T >= LEAST) & countable(item, asking[some], home[some], of_list, probes)
                np.add.at(total, at, asked[some] @ linked)
                np.add.at(total, from_[some], linked @ copies)
                for row in np.flatnonzero(linked.any(axis=1)):
                    mine, others = group[from_[k + row]], at[linked[row]]
                    for old, j in zip(*np.unique(group[others], return_index=True), strict=True):
                        if old != mine:
                            forest.append((int(asking[k + row]), int(ids[others[j]])))
                            group[group == old] = mine
            some = np.flatnonzero(total)
            rows = [*((int(ids[j]), None, int(total[j])) for j in some), *((a, b, None) for a, b in forest)]
            if rows:
                yield record_batch(FOREST, zip(*rows, strict=True))

    full = members.join(classes.select("item", "vector", "dim", F.col("n").alias("copies")), "item")
    return grouped(full).mapInArrow(run, FOREST)


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row: the other vectors it is linked with, the least ``vec_id`` that links reach and whether that is its own."""
    with scratch(vectors.sparkSession) as kept:
        rows = kept(rows_of(vectors), "vectors")
        same = rows.filter("key is not null").groupBy("key", "space", "dim", "vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("vec_id"))
        classes = written(same.select(F.monotonically_increasing_id().alias("item"), "*"), "classes")
        quantiser = fitted(classes)
        if quantiser is None:
            return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
        index = written(indexed(classes, quantiser), "index")
        members = written(promising(index, quantiser), "members")
        found = written(counted(members, classes), "links")
        labels = components(found.filter("b is not null").select("a", "b"))
        more = found.filter("b is null").groupBy(F.col("a").alias("item")).agg(F.sum("n").alias("more"))
        linked = labels.select(F.col("id").alias("item"), F.col("component").alias("group"))
        narrow = classes.select("item", "key", "n", "vec_id")
        whole = written(narrow.join(linked, "item").join(more, "item"), "linked")
        least = written(whole.groupBy("group").agg(F.min("vec_id").alias("component")), "least")
        of_linked = hot_joined(whole, least, "group").select("key", (F.col("n") - 1 + F.col("more")).alias("n_links"), "component", "n")
        copies = small_or_joined(narrow.filter("n > 1"), linked.select("item"), "item", "left_anti").select("key", (F.col("n") - 1).alias("n_links"), F.col("vec_id").alias("component"), "n")
        by_class = kept(of_linked.union(copies), "by-class")
    hot = by_class.filter(F.col("n") > HOT_ROWS).select("key")
    out = hot_joined(rows.select("vec_id", "key"), by_class.drop("n"), "key", "left", hot)
    mine = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), mine.alias("component_id"), F.coalesce(mine == F.col("vec_id"), F.lit(True)).alias("kept"))


def sql() -> str:
    """DuckDB SQL for ``near_duplicates`` over the table ``embeddings``, ids unique, by comparing all pairs of a label."""
    return f"""
WITH RECURSIVE known AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM known a JOIN known b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= {LEAST}),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(counted.n, 0) AS n_links, coalesce(least(vec_id, least.b), vec_id) AS component_id, vec_id = coalesce(least(vec_id, least.b), vec_id) AS kept
FROM (SELECT vec_id FROM embeddings) LEFT JOIN counted ON counted.a = vec_id LEFT JOIN least ON least.a = vec_id"""
