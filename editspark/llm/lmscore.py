"""Language-model scoring by cross-entropy difference.

Two interpolated bigram models, one of a target corpus and one of a background corpus, share the vocabulary of a public tokenizer and
differ in their counts only. A document's score is the mean over its tokens of the background's loss less the target's
loss (nats): positive means nearer to the target. Counts are over every token of every document; a document's own counts
are taken out of both models before it is scored, so that having been counted is no advantage.

With ``c`` the counts of a model, ``V`` the vocabulary's size and ``h`` the token before (the start mark for the first):

    p(w | h) = (c(h, w) + MASS * q(w)) / (c(h) + MASS)      q(w) = (c(w) + 1) / (N + V)

The pairs of a token add up to one less than its count where it ended a text; so what ``p(. | h)`` lacks to one is the chance of the text's end.

Pairs of tokens are counted exactly, however many distinct ones there are. Documents are tokenised once, into chunks of bounded size. Each
chunk sends its distinct pairs with their counts, dealt by hash into ``1 << BITS`` ranges; a range adds the counts of each pair and answers each chunk with the
totals of its pairs, so no table of all pairs is ever in one place, and a hot pair comes once a chunk. A range of more than ``FAN`` chunks is added up
in lanes of about as many first, whose sums are dealt by the hash's next bits in turn (``totals``): the number of blocks is in proportion to that of chunks, and
no task holds more than a lane. Only the counts of single tokens, of the vocabulary's size, are sent to all tasks.

Defined results: a null or empty text has no tokens, losses and score 0; a very long text is scored whole; without target documents both models are smoothing alone on that
side; a document counts as target if any of its labels says so; repeated rows count and are scored each, null ids too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, freed, from_rows, small_or_joined, texts, written
from .packing import tokenizer

MASS = 50.0
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bits of the hash that each level deals by, and members of a range that are added up at once.
BITS, FAN = 9, 512
#: Slices of the counts of single tokens, and lanes in which each is added up first.
SLICES, LANES = 16, 64
#: Bytes of text of a chunk.
CHUNK = 4_000_000


def pairs(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """The token before each token, and the number of each pair, one to one."""
    before = np.concatenate([[vocabulary], ids[:-1]]).astype(np.int64)
    return before, before * (vocabulary + 1) + ids


def mixed(numbers: np.ndarray) -> np.ndarray:
    """Numbers of pairs in hashed order: one to one, and undone by ``unmixed``."""
    x = numbers.astype(np.uint64) * _ODD
    return x ^ (x >> np.uint64(32))


def unmixed(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(32))) * _INVERSE


def flagged(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """``doc_id, text, target``; ``targets(doc_id)`` may repeat ids."""
    ids = targets.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct().withColumn("target", F.lit(True))
    return small_or_joined(texts(docs), ids, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))


def squeezed(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def opened(block: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(zlib.decompress(block), kind)


TOKENS = "chunk long, n long, docs binary, known binary, targets binary, sizes binary, ids binary"


def tokenised(rows: DataFrame, path: str) -> DataFrame:
    """Documents of ``flagged`` in chunks: ids (and whether there is one), targets, numbers of tokens, and all tokens in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(path)
        held: list[tuple] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            docs, targets, found = zip(*held, strict=True)
            sizes = np.array([len(x) for x in found], np.int64)
            columns = (np.array([d or 0 for d in docs], np.int64), np.array([d is not None for d in docs]), np.array(targets, bool), sizes, np.concatenate(found))
            return from_rows(TOKENS, [(uuid.uuid4().int >> 65, int(sizes.sum()), *map(squeezed, columns))])

        for b in batches:
            for c in chunks(b, "text"):
                for doc, text, target in zip(*(c.column(k).to_pylist() for k in ("doc_id", "text", "target")), strict=True):
                    held.append((doc, target, np.array(enc.encode(text), np.uint32)))
                    size += len(text)
                    if size > CHUNK:
                        yield chunk()
                        held, size = [], 0
            freed()
        if held:
            yield chunk()

    return rows.select("doc_id", "text", "target").mapInArrow(run, TOKENS)


class Chunk:
    """The documents of a row of ``TOKENS``."""

    def __init__(self, row: dict, vocabulary: int):
        self.docs, self.known, self.targets, self.sizes = opened(row["docs"]), opened(row["known"], bool), opened(row["targets"], bool), opened(row["sizes"])
        self.ids = opened(row["ids"], np.uint32).astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        numbers = np.zeros(len(self.ids), np.int64)
        for start, end in zip(self.ends - self.sizes, self.ends, strict=True):
            if end > start:
                numbers[start:end] = pairs(self.ids[start:end], vocabulary)[1]
        #: The distinct pairs in hashed order, the place of each token's pair among them, and their counts.
        self.distinct, self.places, self.often = np.unique(mixed(numbers), return_inverse=True, return_counts=True)
        self.of_target = np.repeat(self.targets, self.sizes)


def dealt(distinct: np.ndarray, level: int) -> Iterator[tuple[int, slice]]:
    """(range, its place) of pairs in hashed order, by the bits of a level."""
    of = (distinct >> np.uint64(64 - BITS * (level + 1))) & np.uint64((1 << BITS) - 1)
    found, start = np.unique(of, return_index=True)
    if not len(of):
        return
    yield from ((int(k), slice(i, j)) for k, i, j in zip(found, start, [*start[1:], len(of)], strict=True))


def opened_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[dict]]:
    """Consecutive rows that agree in the keys, by which they must be sorted."""
    for _, rows in itertools.groupby(opened_rows(batches), key=lambda r: [r[k] for k in keys]):
        yield list(rows)


def added(rows: list[dict]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The distinct pairs of blocks in hashed order, where each block's pairs are among them, and the sums of ``often`` and ``target``."""
    blocks = [mixed(opened(r["pairs"])) for r in rows]
    distinct, place = np.unique(np.concatenate(blocks), return_inverse=True)
    sums = [np.bincount(place, np.concatenate([opened(r[side]) for r in rows]), len(distinct)).astype(np.int64) for side in ("often", "target")]  # exact below 2 ** 53
    return distinct, np.split(place, np.cumsum([len(x) for x in blocks])[:-1]), sums


BLOCKS = "key long, member long, pairs binary, often binary, target binary"
ANSWERS = "key long, member long, background binary, of_target binary"


def totals(blocks: DataFrame, members: int, level: int = 0) -> DataFrame:
    """``ANSWERS``: for each of ``BLOCKS`` the sums of its pairs over all blocks of its key, of which there are ``members`` at most."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "key"):
            _, places, sums = added(rows)
            yield from_rows(ANSWERS, [(r["key"], r["member"], *(squeezed(x[place]) for x in sums)) for r, place in zip(rows, places, strict=True)])
        freed()

    if members <= FAN:
        return blocks.repartition("key").sortWithinPartitions("key").mapInArrow(answer, ANSWERS)
    lanes = -(-members // FAN)
    blocks = blocks.withColumn("lane", F.pmod(F.xxhash64("member", F.lit(level)), F.lit(lanes)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "key", "lane"):
            distinct, _, sums = added(rows)
            found, columns = unmixed(distinct).astype(np.int64), []
            for k, at in dealt(distinct, level + 1):
                columns.append((rows[0]["key"] << BITS | k, rows[0]["lane"], *(squeezed(x[at]) for x in (found, *sums))))
            yield from_rows(BLOCKS, columns)
        freed()

    summed = written(blocks.repartition("key", "lane").sortWithinPartitions("key", "lane").mapInArrow(merge, BLOCKS), "lanes")
    said = totals(summed, lanes, level + 1).select(
        F.shiftright("key", BITS).alias("key"), F.col("member").alias("lane"), F.col("key").alias("member"), F.lit(None).cast("binary").alias("pairs"),
        F.col("background").alias("often"), F.col("of_target").alias("target"), F.lit(0).alias("kind"),
    )
    both = blocks.withColumn("kind", F.lit(1)).unionByName(said).repartition("key", "lane").sortWithinPartitions("key", "lane", "kind", "member")

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "key", "lane"):
            mine, sums = [r for r in rows if r["kind"]], [r for r in rows if not r["kind"]]
            _, places, _ = added(mine)
            sums = [np.concatenate([opened(r[side]) for r in sums]) for side in ("often", "target")]  # by the next bits, so in hashed order
            yield from_rows(ANSWERS, [(r["key"], r["member"], *(squeezed(x[place]) for x in sums)) for r, place in zip(mine, places, strict=True)])
        freed()

    return both.mapInArrow(pass_on, ANSWERS)


def counts(chunked: DataFrame, vocabulary: int) -> tuple[np.ndarray, DataFrame]:
    """Counts of single tokens (the start mark last) of background and target, and ``chunk, answers``: the totals of each chunk's pairs, by range."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = np.zeros((2, vocabulary + 1), np.int64)
        for row in opened_rows(batches):
            c = Chunk(row, vocabulary)
            target = np.bincount(c.places[c.of_target], minlength=len(c.distinct))
            numbers = unmixed(c.distinct).astype(np.int64)
            for side, ids, full in ((0, c.ids, c.sizes > 0), (1, c.ids[c.of_target], (c.sizes > 0) & c.targets)):
                tokens[side] += np.bincount(ids, minlength=vocabulary + 1)
                tokens[side][vocabulary] += full.sum()
            yield from_rows(BLOCKS, [(k, row["chunk"], *map(squeezed, (numbers[at], c.often[at], target[at]))) for k, at in dealt(c.distinct, 0)])
            freed()
        if tokens.any():
            lane = TaskContext.get().partitionId() % LANES
            yield from_rows(BLOCKS, [(-1 - k, lane, squeezed(np.ascontiguousarray(part)), b"", b"") for k, part in enumerate(np.array_split(tokens, SLICES, axis=1))])

    found = written(chunked.mapInArrow(gather, BLOCKS), "pairs")
    slices = "key long, member long, pairs binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}  # of SLICES * LANES at most
        for row in opened_rows(batches):
            at = row["key"], row["member"]
            sums[at] = sums.get(at, 0) + opened(row["pairs"])
        yield from_rows(slices, [(*k, squeezed(x)) for k, x in sums.items()])

    single = found.filter("key < 0").select("key", "member", "pairs").repartition("key", "member").mapInArrow(add, slices)
    single = single.withColumn("member", F.lit(0).cast("long")).repartition("key").mapInArrow(add, slices).toArrow()
    parts = {k: opened(block).reshape(2, -1) for k, block in zip(single.column("key").to_pylist(), single.column("pairs").to_pylist(), strict=True)}
    tokens = np.concatenate([parts[-1 - k] for k in range(SLICES)], axis=1) if parts else np.zeros((2, vocabulary + 1), np.int64)
    answers = totals(found.filter("key >= 0"), chunked.count())
    return tokens, answers.groupBy(F.col("member").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("key", "background", "of_target"))).alias("answers"))


def loss(ids: np.ndarray, tokens: np.ndarray, n: int, at: np.ndarray, c_pair: np.ndarray, own: bool) -> float:
    """The mean loss of a text's ids under a model; ``own``: its counts are in the model and are taken out. ``n``: tokens of the model;
    ``at``: equal for equal pairs; ``c_pair``: the model's count of each pair."""
    vocabulary = len(tokens) - 1
    before, _ = pairs(ids, vocabulary)
    c_pair, c_token, c_before = c_pair.astype(np.float64), tokens[ids].astype(np.float64), tokens[before].astype(np.float64)
    if own:
        _, where, often = np.unique(at, return_inverse=True, return_counts=True)
        c_pair -= often[where]
        found, where, often = np.unique(ids, return_inverse=True, return_counts=True)
        c_token -= often[where]
        # each token before another is one of the text's own, but for the start mark, which is there once
        c_before -= np.append(1, often[np.searchsorted(found, before[1:])])
        n -= len(ids)
    q = (c_token + 1) / (n + vocabulary)
    return float(-np.log((c_pair + MASS * q) / (c_before + MASS)).mean())


def scores(docs: DataFrame, targets: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, loss_target, loss_background, score`` of every document."""
    vocabulary = tokenizer(path).n_vocab
    chunked = written(tokenised(flagged(docs, targets), path), "tokens")
    tokens, answers = counts(chunked, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    spec = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        background, target = shared.value
        n_background, n_target = (int(x[:-1].sum()) for x in (background, target))
        for row in opened_rows(batches):
            c, said = Chunk(row, vocabulary), row["answers"] or []
            background_pairs, target_pairs = (np.concatenate([np.zeros(0, np.int64), *(opened(x[side]) for x in said)])[c.places] for side in ("background", "of_target"))
            out = []
            for doc, known, is_target, size, end in zip(c.docs.tolist(), c.known.tolist(), c.targets.tolist(), c.sizes.tolist(), c.ends.tolist(), strict=True):
                doc, at = doc if known else None, slice(end - size, end)
                if not size:
                    out.append((doc, 0, 0.0, 0.0, 0.0))
                    continue
                ids, places = c.ids[at], c.places[at]
                t, g = loss(ids, target, n_target, places, target_pairs[at], is_target), loss(ids, background, n_background, places, background_pairs[at], True)
                out.append((doc, size, t, g, g - t))
            yield from_rows(spec, out)
            freed()

    return chunked.join(answers, "chunk", "left").mapInArrow(run, spec)
