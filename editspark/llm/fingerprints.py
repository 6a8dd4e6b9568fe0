"""Exact document fingerprints: a wide hash of a canonical form, with a comparison of bytes inside equal buckets.

The canonical form is NFKC, case folded, NFKC again, with each run of white space as one space and none at the ends.
Its fingerprint is the 128-bit xxHash in hexadecimal. Fingerprints are equal or not: the likeness of two is 1 or 0, and it is 1
only where the canonical bytes were compared and are equal.

Defined results: a null text is the empty text; a null ``doc_id`` sorts before all others; rows that share a
``doc_id`` follow each other in the order of their texts' hashes; a table of one row is its own next document; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import HOT_ROWS
from .common import hot_joined, record_batch, small_or_joined, texts, written

#: Documents in a range of ids, about; a range is worked on as one sorted stream.
RANGE_ROWS = 4_000
LEAST = -(1 << 63)


def canonical(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.casefold()
    return " ".join(text.split())


def fingerprint(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def likeness(a: bytes, b: bytes, print_a: str, print_b: str) -> float:
    """1 if the fingerprints agree and so do the bytes they stand for, else 0."""
    return float(print_a == print_b and a == b)


def edited(text: str, following: str) -> str:
    """The last half of a text's code points replaced by the first as many of another."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt to ranges of ``doc_id`` and sorted there, each range followed by the first row of the next.

    Range bounds are ids that occur, so a range's first row has the bound as its id and goes, marked as a guest, to the range before
    as well. That takes one shuffle of the texts and never a sort of all rows in one task.
    """
    spark = docs.sparkSession
    base = texts(docs).withColumn("key", F.coalesce("doc_id", F.lit(LEAST)))
    keys = base.select("key")
    size = keys.agg(F.count("*").alias("n"), F.min("key").alias("least")).first()
    parts = max(1, min(-(-size.n // RANGE_ROWS), 20_000))  # more rows than that make ranges longer, which stream all the same
    at = [k / parts for k in range(1, parts)]
    # the bounds must occur, so they are elements (approximate quantiles are), never interpolated; there are at most ``parts``
    found = keys.agg(F.percentile_approx("key", F.array(*map(F.lit, at)) if at else F.array(F.lit(0.5)), 4 * parts).alias("q")).first().q if size.n else []
    heads = sorted({size.least, *(found if at else [])}) if size.n else []
    bounds = spark.sparkContext.broadcast(np.array(heads, np.int64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = bounds.value
        for b in batches:
            key = b.column("key").to_numpy(zero_copy_only=False)
            part = np.maximum(np.searchsorted(starts, key, "right") - 1, 0)
            head = np.flatnonzero(starts[part] == key)
            order = np.concatenate([np.arange(len(key)), head])
            part = np.concatenate([part, (part[head] - 1) % len(starts)])
            guest = np.concatenate([np.zeros(len(key), bool), np.ones(len(head), bool)])
            rows = b.take(pa.array(order))
            yield record_batch("part long, guest boolean, key long, doc_id long, text string", [part, guest, rows.column("key"), rows.column("doc_id"), rows.column("text")])

    dealt = base.mapInArrow(deal, "part long, guest boolean, key long, doc_id long, text string")
    return dealt.withColumn("tie", F.xxhash64("text")).repartition(max(1, len(heads)), "part").sortWithinPartitions("part", "guest", "key", "tie").drop("key", "tie")


def digests(docs: DataFrame) -> DataFrame:
    """One row a document, from one stream over sorted ranges; ``strong`` is a second digest of the canonical form."""
    spec = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, strong binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for k in range(0, b.num_rows, 256):
                    yield from zip(*(b.slice(k, 256).column(c).to_pylist() for c in ("part", "guest", "doc_id", "text")), strict=True)

        out: list[tuple] = []
        held = form = said = None
        done = False
        for part, guest, doc, text in rows():
            mine = canonical(text).encode("utf-8", "surrogatepass")
            mark = fingerprint(mine)
            if held is not None and held[0] == part and not done:
                new = edited(held[2], text)
                new_form = canonical(new).encode("utf-8", "surrogatepass")
                new_mark = fingerprint(new_form)
                out.append(
                    (held[1], len(held[2]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), said, new_mark,
                     likeness(form, new_form, said, new_mark), likeness(form, mine, said, mark), hashlib.sha256(form).digest())
                )
                if len(out) >= 1000:
                    yield record_batch(spec, zip(*out, strict=True))
                    out = []
            # of a range's guests only the first counts: rows with its id are told apart where they belong
            done = guest
            held, form, said = (part, doc, text), mine, mark
        if out:
            yield record_batch(spec, zip(*out, strict=True))

    return with_next(docs).mapInArrow(run, spec)


def verified_groups(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``fingerprint, strong, group_id, group_size`` of the buckets with several rows, their canonical bytes compared.

    ``rows`` has ``doc_id, fingerprint, strong`` of every document. Only texts in such buckets are read again, and grouping by the
    (compressed) bytes pre-aggregates copies where they are, so that a bucket of copies sends one text a task.
    """
    buckets = written(rows.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    hot = buckets.filter(F.col("n") > HOT_ROWS).select("fingerprint")  # a bucket of copies isn't one task's
    members = hot_joined(rows.select("doc_id", "fingerprint"), buckets.select("fingerprint"), "fingerprint", hot=hot).select(F.coalesce("doc_id", F.lit(LEAST)).alias("key"))
    members = written(members.distinct(), "members")
    base = small_or_joined(texts(docs).withColumn("key", F.coalesce("doc_id", F.lit(LEAST))), members, "key", "left_semi")
    spec = "doc_id long, fingerprint string, strong binary, form binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            forms = [canonical(t).encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            yield record_batch(spec, [b.column("doc_id"), [fingerprint(f) for f in forms], [hashlib.sha256(f).digest() for f in forms], [squeeze.compress(f) for f in forms]])

    same = base.select("doc_id", "text").mapInArrow(run, spec).groupBy("fingerprint", "strong", "form").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size"))
    # two forms in one bucket with one second digest would need a joint collision of 384 bits
    once = same.groupBy("fingerprint", "strong").agg(F.count("*").alias("forms"), F.min("group_id").alias("group_id"), F.sum("group_size").alias("group_size"))
    return once.withColumn("group_id", F.when(F.col("forms") == 1, F.col("group_id")).otherwise(F.raise_error("different texts share all digests").cast("long"))).drop("forms")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id, group_size`` of every document."""
    rows = written(digests(docs), "digests")
    groups = written(verified_groups(docs, rows.select("doc_id", "fingerprint", "strong")), "groups")
    names = [c for c in rows.columns if c != "strong"]
    both = F.concat("fingerprint", F.hex("strong")).alias("digests")
    sized = groups.select(both, "group_id", "group_size")
    out = hot_joined(rows.select(*names, both), sized, "digests", "left", sized.filter(F.col("group_size") > HOT_ROWS).select("digests"))
    return out.select(*names, F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
