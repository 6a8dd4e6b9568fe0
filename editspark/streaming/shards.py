"""Structured Streaming over shards (an extension: batches of records as they are appended).

Records arrive as JSON lines; the state is a folder of Parquet tables, one a batch, from which the last record of a case is taken
when it is read. Writing a batch's table is idempotent, so a batch that is run again after a failure leaves the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import last_records
from ..sources.schemas import SHARD


def stream_shard(spark: SparkSession, path: str) -> DataFrame:
    """Records of a folder of JSON lines as a stream; malformed lines and lines without ``case_id`` are left out."""
    lines = spark.readStream.text(path, recursiveFileLookup=True)
    return lines.select(F.from_json("value", SHARD).alias("r")).filter("r.case_id is not null").select("r.*")


def ingest(records: DataFrame, state: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps the last record of each case of every batch under ``state``; ``once`` takes what is there and ends."""

    def write(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn("ordinal", F.monotonically_increasing_id())
        last_records(numbered).drop("first_ordinal").write.mode("overwrite").parquet(f"{state}/batch={number}")

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, state: str) -> DataFrame:
    """The last record of each case so far, with the number of the batch it came in."""
    rows = spark.read.parquet(state).withColumn("ordinal", F.struct(F.col("batch").cast("long"), F.col("ordinal")))
    return last_records(rows).drop("first_ordinal", "ordinal")


def summary(records: DataFrame) -> DataFrame:
    """Numbers and mean scores by modality of a stream, for output mode ``complete``; counts every record, not only last ones."""
    return records.groupBy(F.coalesce("modality", F.lit("?")).alias("modality")).agg(F.count("*").alias("n"), F.avg("res").alias("mean_res"))


__all__ = ["current", "ingest", "stream_shard", "summary"]
