"""A session set up for the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What the engine counts on; sizes of partitions are left to adaptive execution and the cluster's own settings.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """The running session with the engine's settings, or a new one; ``settings`` with dots written as two underscores."""
    builder = SparkSession.builder.appName("editspark")
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
