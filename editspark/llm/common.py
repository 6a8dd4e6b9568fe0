"""Helpers shared by the corpus operators: shared scratch tables and defensive column handling."""

from __future__ import annotations

import contextlib
import ctypes
import pickle
import re
import warnings
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import bytes_of, hot_joined, scratch, small_or_joined, spread, written  # noqa: F401  for the operators and the pipeline

#: Bytes of the batches that Python workers get at a time.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, so that workers' memory doesn't follow the length of texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key, "64m"))) != BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and the named columns, whatever else the table has."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[F.col(c) for c in more])
    return spread(rows)


def fold(modulus: int, column: str = "doc_id"):
    """``crc32`` of an id's decimal text, modulo ``modulus``; null ids count as the text ``null``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % modulus


def thinned(key: Column, wanted: int, rows: Column) -> Column:
    """Whether a row's hash of ``key`` is among about four times ``wanted`` of ``rows`` rows (all, if there are fewer).

    A first cut before rows are ranked by that hash: what reaches the ranking doesn't grow with the number of tasks.
    """
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 32)).cast("double") * rows < 4.0 * wanted * (1 << 32)


def freed() -> None:
    """Gives memory that Arrow and the allocator keep for later back to the system, so that workers that are used again don't add up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def judged(docs: DataFrame, judge: Callable[[list[str]], Iterable], spec: str, keep_rows: bool = False) -> DataFrame:
    """Rows with the columns of ``spec`` that ``judge`` makes from a list of texts (null: empty).

    In front of them stands ``doc_id``, or with ``keep_rows`` the whole row as the struct ``row``, so that no column of it can clash.
    """
    small_batches(docs.sparkSession)
    if keep_rows:
        base, front = spread(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), T.StructType([T.StructField("row", docs.schema)])
    else:
        base, front = texts(docs), T.StructType([T.StructField("doc_id", T.LongType())])
    out = T.StructType([*front.fields, *T._parse_datatype_string(spec).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = b.column("row").field("text") if keep_rows else b.column("text")
            for start, n in slices(said):
                found = record_batch(spec, judge([t or "" for t in said.slice(start, n).to_pylist()]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, n), *found.columns], [b.schema.names[0], *found.schema.names])
            del said
            freed()

    return base.mapInArrow(run, out)


#: Bytes of text that are worked on at a time.
CHUNK = 4_000_000


def slices(said: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of texts that hold about ``CHUNK`` bytes, a row at least."""
    start = held = 0
    for k, n in enumerate(pc.binary_length(said).to_pylist()):
        if held and held + (n or 0) > CHUNK:
            yield start, k - start
            start, held = k, 0
        held += n or 0
    if start < len(said):
        yield start, len(said) - start


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``CHUNK`` bytes of a column."""
    for start, n in slices(batch.column(column)):
        yield batch.slice(start, n)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def record_batch(spec: str, columns: Iterable) -> pa.RecordBatch:
    """A batch of the columns (lists, numpy or Arrow arrays) that ``spec``, such as ``a long, b string``, names and types."""
    fields = [f.split() for f in spec.split(",")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def from_rows(spec: str, rows: list[tuple]) -> pa.RecordBatch:
    return record_batch(spec, zip(*rows, strict=True) if rows else [[] for _ in spec.split(",")])


#: Bytes of a sample up to which the driver trains; of a row of a model that is sent to it.
SMALL_SAMPLE, PIECE = 4_000_000, 4_000_000


def trained(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """What ``fit`` makes of a ``sample`` of bounded size.

    A task trains on any but a small one, so that the driver's Python and JVM hold neither the sample nor copies of it, only the model; what ``fit`` warns of is said by the driver.
    """
    spec = "at long, piece binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            model = fit(pa.Table.from_batches(held))
        held.clear()
        out = pickle.dumps((model, [str(w.message) for w in said if w.category is UserWarning]))
        for at in range(0, len(out), PIECE):
            yield record_batch(spec, [[at], [out[at : at + PIECE]]])
        freed()

    with scratch(sample.sparkSession):
        sample = written(sample, "sample")
        if bytes_of(sample) <= SMALL_SAMPLE:
            return fit(sample.toArrow())
        pieces = sample.repartition(1).mapInArrow(run, spec).toArrow().sort_by("at").column("piece").to_pylist()
    model, said = pickle.loads(b"".join(pieces))
    for message in said:
        warnings.warn(message, stacklevel=3)
    return model
