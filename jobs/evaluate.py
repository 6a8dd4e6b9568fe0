"""Evaluates the rule-based reports of a table of conversations: the run that the figures of a release come from.

    python -m jobs.evaluate --conversations CONVERSATIONS --target EVALUATIONS

Conversations become cases (``editspark.plans.fixtures``); every case's report is generated by rules, validated and scored against its own, and cases are dealt to stratified folds
(``editspark.plans.crossval``). ``target`` then holds, for each ``run``, the table ``cases`` partitioned by ``fold`` and the table ``summary`` partitioned by ``level``: means and counts by fold, by
modality and over all. Cases are generated and scored once: the summary is made, in one pass of grouping sets, from the scores that were written. A run replaces its own folder and no
other, so a second run with the same input leaves the same result.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editspark.operators import evaluate as E
from editspark.plans import crossval, fixtures
from editspark.sources.scratch import scratch

from .common import command, log

CASES = "case_id string, row_idx long, modality string, body_part string, valid boolean, res_case double, findings_score double, impression_score double, fold int, run string"
SUMMARY = "modality string, fold int, cases long, invalid long, mean_res double, mean_findings double, mean_impression double, level string, run string"


def summarised(scores: DataFrame) -> DataFrame:
    """``level`` (fold, modality or all), its ``fold`` or ``modality``, counts and means."""
    grouped = scores.groupingSets([[F.col("fold")], [F.col("modality")], []], "fold", "modality").agg(
        F.grouping_id().alias("g"), F.count("*").alias("cases"), F.count_if(~F.col("valid")).alias("invalid"),
        F.avg("res_case").alias("mean_res"), F.avg("findings_score").alias("mean_findings"), F.avg("impression_score").alias("mean_impression"),
    ).filter("cases > 0")
    level = F.when(F.col("g") == 1, "fold").when(F.col("g") == 2, "modality").otherwise("all")
    return grouped.select("modality", "fold", "cases", "invalid", "mean_res", "mean_findings", "mean_impression", level.alias("level"))


def evaluate(spark: SparkSession, conversations: str, target: str, run: str = "rules", folds: int = E.FOLDS) -> DataFrame:
    """Writes the run's tables and returns ``read``."""
    cases = fixtures.cases_of(spark.read.parquet(conversations))
    names = [c.split()[0] for c in CASES.split(", ")[:-1]]
    with scratch(spark):
        scored = crossval.cross_validated(cases, folds=folds)
        scored.select(*names).repartition("fold", F.pmod(F.xxhash64("case_id"), F.lit(spark.sparkContext.defaultParallelism))).write.mode("overwrite").partitionBy("fold").parquet(f"{target}/cases/run={run}")
    scores = spark.read.schema(CASES).parquet(f"{target}/cases").filter(F.col("run") == run)
    summarised(scores).repartition("level").write.mode("overwrite").partitionBy("level").parquet(f"{target}/summary/run={run}")
    for r in spark.read.schema(SUMMARY).parquet(f"{target}/summary").filter((F.col("run") == run) & (F.col("level") == "all")).collect():  # one row
        log.info("%s: %d cases of %s scored in %s, %d invalid, mean %.6f", run, r.cases, conversations, target, r.invalid, r.mean_res)
    return read(spark, target, run)


def read(spark: SparkSession, target: str, run: str) -> DataFrame:
    """Both tables of a run as one: a case is a group of one."""
    cases = spark.read.schema(CASES).parquet(f"{target}/cases").filter(F.col("run") == run)
    one = cases.select(
        F.lit("case").alias("level"), "case_id", "fold", "modality", F.lit(1).cast("long").alias("cases"), (~F.col("valid")).cast("long").alias("invalid"),
        F.col("res_case").alias("mean_res"), F.col("findings_score").alias("mean_findings"), F.col("impression_score").alias("mean_impression"),
    )
    summary = spark.read.schema(SUMMARY).parquet(f"{target}/summary").filter(F.col("run") == run)
    return one.union(summary.select("level", F.lit(None).cast("string"), "fold", "modality", "cases", "invalid", "mean_res", "mean_findings", "mean_impression"))


if __name__ == "__main__":
    command(evaluate, "Scores rule-based reports of conversations.", os.path.splitext(__file__)[0] + ".json", ("conversations", "target"))
