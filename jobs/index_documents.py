"""Keeps a retrieval index up to date with a growing table of documents.

    python -m jobs.index_documents --source DOCUMENTS --target INDEX --checkpoint CHECKPOINT

Each run takes the Parquet files of ``source`` that no earlier run took, as a file stream that ends when they are read, tokenises their documents and adds them to the index
under ``target`` (``editspark.operators.index``): partitioned postings, documents and statistics. The checkpoint is the only memory of what was taken. A batch that failed is
repeated under its number and replaces what it left; documents that the index has are not added again, even if the checkpoint is lost. ``source`` is a folder of files or one file.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editspark.operators import index

from .common import command, log


def as_pattern(path: str) -> str:
    """The path as a pattern that matches it alone: a file stream takes a single file only so."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/{{{name}}}"


def index_documents(spark: SparkSession, source: str, target: str, checkpoint: str, id_column: str = "doc_id", text_column: str = "text", buckets: int = index.BUCKETS, files_per_batch: int = 1000) -> int:
    """Adds what is new in ``source`` to the index ``target`` and says how many documents that were."""
    schema = spark.read.parquet(source).schema
    added = 0

    def take(batch: DataFrame, number: int) -> None:
        nonlocal added
        rows = batch.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
        n = index.add(rows, target, number, buckets)
        log.info("batch %d: %d new documents of %s in %s", number, n, source, target)
        added += n

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(as_pattern(source))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%d documents added", added)
    return added


if __name__ == "__main__":
    command(index_documents, "Adds new documents to a retrieval index.", os.path.splitext(__file__)[0] + ".json", ("source", "target", "checkpoint"))
