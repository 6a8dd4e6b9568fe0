"""Intermediate tables in the folder that all executors share, and joins that choose their plan by measured size."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a table may be broadcast, counted over its rows; beyond it every caller has a shuffle join.
BROADCAST_BYTES = 32 << 20
#: Rows of a key beyond which a shuffle join doesn't send them to one task.
HOT_ROWS = 200_000
#: Bytes of a table that a core reads at least.
SPLIT_BYTES = 32 << 20

_scope: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a folder of this machine only where that is unset and everything runs here (tests)."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    if not context.isLocal():
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="editspark-"))
    return context.getCheckpointDir().get()


def _in_hadoop(spark: SparkSession, path: str) -> tuple:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back.

    This cuts the lineage without relying on any executor's local disk, and freezes values that depend on
    how rows were dealt to tasks. The files go at the end of the surrounding ``scratch``, else when the driver's JVM exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/editspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (held := _scope.get()) is not None:
        held.append(path)
    files, hadoop = _in_hadoop(spark, path)
    files.deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Drops the tables that are ``written`` inside at its end, but for those made by the function that it gives."""
    outer, mine = _scope.get(), []
    token = _scope.set(mine)

    def kept(df: DataFrame, name: str) -> DataFrame:
        inner = _scope.set(outer)
        try:
            return written(df, name)
        finally:
            _scope.reset(inner)

    try:
        yield kept
    finally:
        _scope.reset(token)
        for path in mine:
            files, hadoop = _in_hadoop(spark, path)
            files.delete(hadoop, True)
            files.cancelDeleteOnExit(hadoop)


def bytes_of(df: DataFrame) -> int:
    """About what a broadcast of the table takes: measured lengths of texts and arrays of bytes, eight bytes for anything else."""
    long = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    fixed = 16 + 8 * (len(df.columns) - len(long))
    sizes = [F.sum(F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))) for c in long]
    n, *lengths = df.agg(F.count("*"), *sizes).first()
    return n * fixed + sum(x or 0 for x in lengths)


def small_or_joined(left: DataFrame, right: DataFrame, on, how: str, size: int | None = None) -> DataFrame:
    """Join with ``right`` broadcast if it has at most ``BROADCAST_BYTES`` (``size``, if that is known), else by a shuffle."""
    return left.join(F.broadcast(right) if (bytes_of(right) if size is None else size) <= BROADCAST_BYTES else right, on, how)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a table is small and in fewer files than there are cores, each of which may be one task; any other is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >= cores * SPLIT_BYTES or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def hot_joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``inner`` or ``left`` join with ``right``, which has a row a key at most, such that no key of ``left`` gathers in one task.

    ``hot``: those keys, if they are known. A small ``right`` is broadcast. Otherwise its rows of keys that ``left`` has more than ``HOT_ROWS`` times are broadcast (there are few: the rows of
    ``left`` over ``HOT_ROWS``), other keys meet by a shuffle, and null keys, which match nothing, stay where they are.
    """
    if bytes_of(right) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), key, how)
    if hot is None:
        left = written(left, "left")
        hot = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT_ROWS)
    hot = written(hot.select(key, F.lit(True).alias("_hot")), "hot")
    if hot.isEmpty():
        return left.join(right, key, how)
    marked = left.join(F.broadcast(hot), key, "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    few = right.join(F.broadcast(hot.select(key)), key, "left_semi")
    columns = [key, *(c for c in left.columns if c != key), *(c for c in right.columns if c != key)]
    parts = [marked.filter(F.col(key).isNotNull() & ~F.col("_hot")).join(right, key, how), marked.filter("_hot").join(F.broadcast(few), key, how)]
    if how == "left":
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != key]
        parts.append(marked.filter(F.col(key).isNull()).select("*", *nothing))
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.union(part.select(*columns))
    return out
