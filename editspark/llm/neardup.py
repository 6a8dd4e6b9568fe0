"""MinHash near-duplicates by a chosen-path set similarity join, links confirmed on the full sets.

A document's set is its distinct five-word shingles (see ``shingles``). Documents with equal sets are one class, found by a
128-bit digest; the join runs on classes (``item``, a number of the written table of classes).

Chosen paths: each of ``TREES`` independent trees splits the classes by minwise tokens. At a node, a seed made from the tree and
the path chooses one of the ``COORDINATES`` minwise hashes, and with probability ``1 / similarity - 1`` a second one; a class goes
to the child named by its value there. Two documents of the target similarity thus stay together in about one path a level. A
node with few classes is a leaf, compared exhaustively: first by one-bit sketches, then on full sets. Larger nodes are split again, ``DEPTH`` times at most.

A leaf sends its members' numbers only, never pairs: its clusters by sketches, each named by a digest of its members, so that a cluster which several
leaves see is confirmed once. Full sets meet once a cluster, and a cluster's confirmed links are a spanning forest.

What is left beyond ``DEPTH`` is a node whose documents share ``DEPTH`` chosen minwise tokens: mostly copies of one text. It is
dealt into small blocks, each with the same few hubs of the node (the documents nearest to its majority sketch). Copies of one text are
one component after that. Where a node still holds several components (``across``), its full sets are compared block against block, in
tasks of bounded size; only pairs inside the node's largest component, which are linked already, are left out. So nothing beyond ``DEPTH`` is lost, and no
pair of documents is ever listed for a whole node.

Recall: a pair of the target similarity misses one tree's first split with probability under 0.15 and its leaf in all trees with
under 0.15 ** TREES; measured figures are in the README.

Defined results: texts without words (null, empty or white space) have an empty set, are linked with nothing and are kept; fewer than five words are
one shingle; a very long text is one set like any other; repeated rows each get a row; rows that share a ``doc_id`` but differ in text belong to the classes of
their own texts; rows without a ``doc_id`` take no part in links, are their own component (null) and are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, freed, from_rows, hot_joined, record_batch, scratch, small_or_joined, texts, thinned, written
from .components import components

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
TREES, COORDINATES, DEPTH = 8, 128, 4
#: Documents of a leaf; of a block of what is left; hubs of a block; documents from which a majority sketch is made.
LEAF, BLOCK, HUBS, MAJORITY = 64, 48, 4, 64
#: One-bit sketches agree in this many of COORDINATES bits at least for a pair to be looked at: 0.925 expected at the target, less six deviations.
AGREE = 100

#: Documents and shingles of a side of a comparison of blocks, on average; columns of its matrices.
SIDE, SIDE_SHINGLES, COLUMNS = 1024, 2_000_000, 2048

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_STEPS = _mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
_SALTS = _mixed(np.arange(100, 100 + COORDINATES, dtype=np.uint64) * _ODD)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles: A-Z lower-cased, words between ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total += _mixed(h[k : k + len(total)] ^ _STEPS[k]) * _STEPS[k]
    return np.unique(_mixed(total + _STEPS[n - 1]))


def signature(found: np.ndarray) -> np.ndarray:
    """The least of each of ``COORDINATES`` hash functions over a set; 32 bits of each are kept."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096]
        for k in range(COORDINATES):
            least[k] = min(least[k], ((part ^ _SALTS[k]) * _ODD).min())
    return (_mixed(least) >> np.uint64(32)).astype("<u4")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two full sets are linked, in integers."""
    if min(len(a), len(b)) * 100 < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


SIGNED = "doc_id long, text_key long, n_shingles long, set_id binary, sig binary, s0 long, s1 long"


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text``, the named columns and ``text_key``, by which the rows of one text are known where rows repeat an id."""
    return texts(docs, *more).withColumn("text_key", F.xxhash64("text"))


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key``, size and 128-bit digest of the set, its signature and its one-bit sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, "text"):
                rows = []
                for doc, key, text in zip(*(c.column(x).to_pylist() for x in ("doc_id", "text_key", "text")), strict=True):
                    found = shingles(text)
                    if not len(found):
                        rows.append((doc, key, 0, None, None, 0, 0))
                        continue
                    sig = signature(found)
                    s0, s1 = np.packbits((sig & 1).astype(np.uint8)).view(">i8").tolist()
                    rows.append((doc, key, len(found), xxhash.xxh3_128_digest(found.tobytes()), sig.tobytes(), s0, s1))
                yield from_rows(SIGNED, rows)
            freed()

    return keyed(docs).mapInArrow(run, SIGNED)


def classes(all_rows: DataFrame) -> DataFrame:
    """``item, set_id, doc_id, text_key, n, sig, s0, s1`` of each distinct set: its number, its least document and that one's text."""
    rows = all_rows.filter("set_id is not null and doc_id is not null")
    found = rows.groupBy("set_id").agg(
        F.min(F.struct("doc_id", "text_key")).alias("of"), F.max("n_shingles").alias("n"), F.max("sig").alias("sig"), F.max("s0").alias("s0"), F.max("s1").alias("s1")
    )
    return found.select(F.monotonically_increasing_id().alias("item"), "set_id", "of.doc_id", "of.text_key", "n", "sig", "s0", "s1")


NODES = "node long, item long, n long, s0 long, s1 long"
#: Bytes of a row of a table of a few numbers, in a broadcast.
NARROW = 48


def _choices(node: int) -> list[int]:
    """The coordinates that the documents of a node are split by."""
    x = [int(v) for v in _mixed(np.uint64(node & (1 << 64) - 1) + np.arange(1, 4, dtype=np.uint64) * _ODD)]
    first, second = x[0] % COORDINATES, x[1] % COORDINATES
    return [first, second] if x[2] < (100 / PERCENT - 1) * 2**64 and second != first else [first]


def _child(node: int, coordinate: int, value: int) -> int:
    x = int(_mixed(np.uint64((node * 31 + coordinate * 0x10001 + value * 0x100000001B3 + 7) & (1 << 64) - 1).reshape(1))[0])
    return x - (1 << 64) if x >= 1 << 63 else x


def children(rows: DataFrame) -> DataFrame:
    """Of ``node, item, n, s0, s1, sig``: the same classes in the nodes below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choices: dict[int, list[int]] = {}
        for b in batches:
            out = []
            for node, item, n, s0, s1, sig in zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True):
                if node not in choices:
                    if len(choices) > 100_000:
                        choices.clear()
                    choices[node] = _choices(node)
                values = np.frombuffer(sig, "<u4")
                out += [(_child(node, k, int(values[k])), item, n, s0, s1) for k in choices[node]]
            yield from_rows(NODES, out)

    return rows.select("node", "item", "n", "s0", "s1", "sig").mapInArrow(run, NODES)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[tuple]]:
    """Consecutive rows with one key, the key first; rows must be sorted by it. Used where a key's rows are bounded."""
    held: list[tuple] = []
    for b in batches:
        names = [key, *(c for c in b.schema.names if c != key)]
        for k in range(0, b.num_rows, 4096):
            for row in zip(*(b.slice(k, 4096).column(c).to_pylist() for c in names), strict=True):
                if held and held[0][0] != row[0]:
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def clusters(n: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """A label for each member of a leaf, in ascending order of the sizes ``n``: equal for those that sizes and sketches may link, directly or through others."""
    label = np.arange(len(n))
    ends = np.searchsorted(n, n * 100 // PERCENT, "right")  # later ones are larger: beyond, sizes alone forbid a link
    for k in range(len(n) - 1):
        end = int(ends[k])
        if end > k + 1 and (label[k + 1 : end] != label[k]).any():
            apart = np.bitwise_count(sketch[k + 1 : end] ^ sketch[k]).sum(axis=1, dtype=np.int64)
            met = np.unique(label[k + 1 : end][apart <= COORDINATES - AGREE])
            if len(met):
                label[np.isin(label, met)] = label[k]
    return label


def promising(leaves: DataFrame) -> DataFrame:
    """``unit, item`` of the members of each cluster of a leaf or block: at most a row a member of a leaf, and a cluster once however many leaves see it."""
    spec = "unit long, item long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in groups(batches, "node"):
            if len(rows) < 2:
                continue
            rows = sorted({r[1]: r for r in rows}.values(), key=lambda r: r[2])
            item, n = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
            label = clusters(n, np.array([r[3:5] for r in rows], np.int64).view(np.uint64))
            for x, size in zip(*np.unique(label, return_counts=True), strict=True):
                if size > 1:
                    members = np.sort(item[label == x])
                    unit = xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63)
                    out += [(unit, m) for m in members.tolist()]
            if len(out) > 50_000:
                yield from_rows(spec, out)
                out = []
        yield from_rows(spec, out)

    return leaves.repartition("node").sortWithinPartitions("node").mapInArrow(run, spec).distinct()


def blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """What is left beyond ``DEPTH``, dealt into blocks, each with the hubs of its node."""
    room = sizes.count() * NARROW
    by_hash = Window.partitionBy("node").orderBy(F.pmod(F.xxhash64("item", F.lit("sample")), F.lit(1 << 32)), "item")
    some = small_or_joined(rows, sizes, "node", "inner", room).filter(thinned(F.col("item"), MAJORITY, F.col("size")))
    some = some.withColumn("r", F.row_number().over(by_hash)).filter(F.col("r") <= MAJORITY).select("node", "s0", "s1")
    spec = "node long, m0 long, m1 long"

    def majority(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for members in groups(batches, "node"):
            bits = np.unpackbits(np.array([m[1:] for m in members], ">i8").view(np.uint8).reshape(len(members), -1), axis=1)
            out.append((members[0][0], *np.packbits(bits.mean(axis=0) > 0.5).view(">i8").tolist()))
        yield from_rows(spec, out)

    typical = written(some.repartition("node").sortWithinPartitions("node").mapInArrow(majority, spec), "majority")
    near = small_or_joined(rows, typical, "node", "inner", room).withColumn("apart", F.bit_count(F.col("s0").bitwiseXOR(F.col("m0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("m1"))))
    hubs = near.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("apart", "item"))).filter(F.col("r") <= HUBS)
    sized = sizes.select("node", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    dealt = small_or_joined(rows, sized, "node", "inner", room).withColumn("block", F.pmod(F.xxhash64("item", F.lit("block")), F.col("blocks")))
    copies = small_or_joined(hubs.select("node", "item", "n", "s0", "s1"), sized, "node", "inner", room).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cols = [F.xxhash64("node", "block").alias("node"), "item", "n", "s0", "s1"]
    return dealt.select(*cols).union(copies.select(*cols))


def leaves(reps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``node, item, n, s0, s1`` of every leaf and block of all trees over the classes, and the whole nodes left beyond ``DEPTH``."""
    roots = F.explode(F.array(*(F.xxhash64(F.lit(k), F.lit("tree")) for k in range(TREES))))
    rows = written(children(reps.withColumn("node", roots)), "nodes")  # a few rows a class and tree, by design
    out = None
    for depth in range(1, DEPTH + 1):
        large = written(rows.groupBy("node").agg(F.count("*").alias("size")).filter(F.col("size") > LEAF), "large")
        room = large.count() * NARROW
        done = small_or_joined(rows, large.select("node"), "node", "left_anti", room) if room else rows
        out = done if out is None else out.union(done)
        if not room:
            return out, None
        rest = small_or_joined(rows, large.select("node"), "node", "left_semi", room)
        if depth == DEPTH:
            return out.union(blocks(rest, large)), rest
        rows = written(children(rest.join(reps.select("item", "sig"), "item")), "nodes")
    return out, None


def packed(docs: DataFrame, reps: DataFrame, members: DataFrame) -> DataFrame:
    """``item, blob``: the compressed text of each class of ``members``."""
    wanted = written(reps.join(members.select("item").distinct(), "item", "left_semi").select("item", "doc_id", "text_key"), "wanted")
    spec = "item long, blob binary"

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield record_batch(spec, [b.column("item"), [pack.compress(t.encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()]])

    found = small_or_joined(keyed(docs), wanted, ["doc_id", "text_key"], "inner").select("item", "text")
    return found.mapInArrow(squeeze, spec).groupBy("item").agg(F.max("blob").alias("blob"))  # rows may repeat


def links(docs: DataFrame, reps: DataFrame, members: DataFrame) -> DataFrame:
    """``a, b``: a spanning forest of the confirmed links of each unit of ``members(unit, item)``, a bounded number of classes each."""
    found = "a long, b long"

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, out = zstandard.ZstdDecompressor(), []
        for rows in groups(batches, "unit"):
            sets = sorted(((shingles(unpack.decompress(blob).decode("utf-8", "surrogatepass")), item) for _, item, blob in rows), key=lambda x: len(x[0]))
            group = list(range(len(sets)))
            for k, (mine, item) in enumerate(sets):
                for j in range(k + 1, len(sets)):
                    if len(mine) * 100 < PERCENT * len(sets[j][0]):
                        break
                    if group[j] != group[k] and similar(mine, sets[j][0]):
                        out.append((item, sets[j][1]))
                        old, new = group[j], group[k]
                        group = [new if g == old else g for g in group]
            if len(out) > 20_000:
                yield from_rows(found, out)
                out = []
        yield from_rows(found, out)

    return members.join(packed(docs, reps, members), "item").select("unit", "item", "blob").repartition("unit").sortWithinPartitions("unit").mapInArrow(confirm, found)


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all sets of ``a`` with all of ``b``, by products of 0-1 matrices over the shingles that both sides have."""
    out = np.zeros((len(a), len(b)), np.float32)  # exact below 2 ** 24 shingles a set
    both = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    sides = []
    for sets in (a, b):
        values, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        column = np.searchsorted(both, values)
        known = column < len(both)
        known[known] = both[column[known]] == values[known]
        order = np.argsort(column[known], kind="stable")
        sides.append((row[known][order], column[known][order]))
    for at in range(0, len(both), COLUMNS):
        width, parts = min(COLUMNS, len(both) - at), []
        for (row, column), sets in zip(sides, (a, b), strict=True):
            start, end = np.searchsorted(column, (at, at + width))
            part = np.zeros((len(sets), width), np.float32)
            part[row[start:end], column[start:end] - at] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def across(docs: DataFrame, reps: DataFrame, rest: DataFrame, labels: DataFrame) -> DataFrame | None:
    """``a, b``: links between different components of ``labels(id, component)`` within the nodes ``rest``, enough to connect what is linked; None if there is nothing to compare.

    The documents outside a node's largest component are dealt into blocks that meet each other, themselves and the blocks of that component.
    """
    named = labels.select(F.col("id").alias("item"), "component")
    rows = small_or_joined(rest.select("node", "item", "n"), named, "item", "left").select("node", "item", "n", F.coalesce("component", "item").alias("label"))
    rows = written(rows, "labelled")
    shares = rows.groupBy("node", "label").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    largest = F.struct("size", "label", "n")
    nodes = shares.groupBy("node").agg(F.count("*").alias("labels"), F.max(largest).alias("main"), F.sum("size").alias("size"), F.sum("n").alias("n")).filter("labels > 1")
    many = lambda size, n: F.greatest(F.ceil(size / SIDE), F.ceil(n / SIDE_SHINGLES))
    minor, major = many(F.col("size") - F.col("main.size"), F.col("n") - F.col("main.n")), many(F.col("main.size"), F.col("main.n"))
    nodes = written(nodes.select("node", F.col("main.label").alias("main"), minor.alias("minor"), major.alias("major")), "unsettled")
    room = nodes.count() * NARROW
    if not room:
        return None
    dealt, of_main = small_or_joined(rows, nodes, "node", "inner", room), F.col("label") == F.col("main")
    mixed = F.xxhash64("item", F.lit("side"))
    dealt = dealt.withColumn("block", F.when(of_main, F.col("minor") + F.pmod(mixed, F.col("major"))).otherwise(F.pmod(mixed, F.col("minor"))))
    others = F.sequence(F.lit(0).cast("long"), F.when(of_main, F.col("minor")).otherwise(F.col("minor") + F.col("major")) - 1)
    dealt = dealt.withColumn("other", F.explode(others))
    unit = F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))
    members = written(dealt.select(unit.alias("unit"), "item", "block", "label"), "sides")
    found = "a long, b long"

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for rows in groups(batches, "unit"):
            if len({label for _, _, _, label, _ in rows}) < 2:
                continue
            sides: dict[int, list] = {}
            for _, item, block, label, blob in rows:
                sides.setdefault(block, []).append((item, label, shingles(unpack.decompress(blob).decode("utf-8", "surrogatepass"))))
            one, other = (list(sides.values()) * 2)[:2]
            size = [np.array([len(x) for _, _, x in side], np.int64) for side in (one, other)]
            both = shared([x for _, _, x in one], [x for _, _, x in other])
            linked = 100 * both >= PERCENT * (size[0][:, None] + size[1][None] - both)
            mine, theirs = (np.array([label for _, label, _ in side], np.int64) for side in (one, other))
            out = []
            for k in np.flatnonzero(linked.any(axis=1)):
                partners = np.flatnonzero(linked[k] & (theirs != mine[k]))
                for old, j in zip(*np.unique(theirs[partners], return_index=True), strict=True):
                    out.append((one[k][0], other[partners[j]][0]))
                    mine[mine == old], theirs[theirs == old] = (new := mine[k]), new
            yield from_rows(found, out)
            freed()

    return members.join(packed(docs, reps, members), "item").select("unit", "item", "block", "label", "blob").repartition("unit").sortWithinPartitions("unit").mapInArrow(confirm, found)


def least_of_components(reps: DataFrame, labels: DataFrame) -> DataFrame:
    """``set_id, component, component_key``: the least document, and its text's key, of all classes of a class's component."""
    named = written(labels.select(F.col("id").alias("item"), F.col("component").alias("label")).join(reps.select("item", "set_id", "doc_id", "text_key"), "item"), "named")
    least = named.groupBy("label").agg(F.min(F.struct("doc_id", "text_key")).alias("of")).select("label", F.col("of.doc_id").alias("component"), F.col("of.text_key").alias("component_key"))
    linked = written(hot_joined(named.select("label", "set_id"), written(least, "least"), "label").select("set_id", "component", "component_key"), "of-classes")
    alone = small_or_joined(reps.select("item", "set_id", "doc_id", "text_key"), labels.select(F.col("id").alias("item")), "item", "left_anti")
    return linked.union(alone.select("set_id", "doc_id", "text_key"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document; then ``text_key`` (see ``keyed``) and ``stands``: whether a row's id and text stand for its group.

    Of an id with several texts in its own group, all are ``kept`` and one ``stands``.
    """
    with scratch(docs.sparkSession) as kept:
        all_rows = kept(signed(docs), "signed")
        reps = written(classes(all_rows), "classes")
        found, rest = leaves(reps)
        members = written(promising(found), "members")
        linked = written(links(docs, reps, members), "linked")
        labels = components(linked)
        more = None if rest is None else across(docs, reps, rest, labels)
        if more is not None:
            more = written(more, "more")
            if not more.isEmpty():
                labels = components(linked.union(more))
        by_class = kept(least_of_components(reps, labels), "by-class")
    out = hot_joined(all_rows.select("doc_id", "n_shingles", "set_id", "text_key"), by_class, "set_id", "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", mine.alias("component_id"), F.coalesce(mine == F.col("doc_id"), F.lit(True)).alias("kept"), "text_key",
        (F.col("doc_id").isNull() | F.col("component").isNull() | ((mine == F.col("doc_id")) & (F.col("component_key") == F.col("text_key")))).alias("stands"),
    )


def sql() -> str:
    """DuckDB SQL for the first four columns of ``near_duplicates`` over the table ``documents``, by comparing all pairs that share a shingle."""
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - {SHINGLE - 2}, 2)), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL HAVING 100 * count(*) >= {PERCENT} * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(min(b), doc_id)) AS component_id, doc_id = least(doc_id, coalesce(min(b), doc_id)) AS kept
FROM sets LEFT JOIN reach ON a = doc_id GROUP BY doc_id, s"""
