"""Resumable batches: slices, what is still to do, status, completion and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_rows(cases: DataFrame, n: int | None) -> DataFrame:
    """Rows before position ``n``; all if it is none or 0."""
    return cases.filter(F.col("row_idx") < n) if n else cases


def slice_window(cases: DataFrame, start: int, count: int) -> DataFrame:
    """Rows ``start`` to ``start + count - 1`` by position; none beyond the end."""
    return cases.filter((F.col("row_idx") >= start) & (F.col("row_idx") < start + count))


def resume_todo(cases: DataFrame, done: DataFrame) -> DataFrame:
    """Cases without a record."""
    return cases.join(done.select("case_id"), "case_id", "left_anti")


def batch_status(cases: DataFrame, done: DataFrame) -> DataFrame:
    """``n_done`` records, ``n_total`` cases, ``pct`` to one decimal, and ``next_start``, the first case without a record (null if complete)."""
    n_done = done.select(F.count_distinct("case_id").alias("n_done"))
    missing = resume_todo(cases.select("case_id", "row_idx"), done).agg(F.min("row_idx").alias("next_start"))
    total = cases.agg(F.count("*").alias("n_total"))
    # three tables of one row each
    one = n_done.join(total, F.lit(True)).join(missing, F.lit(True))
    return one.select("n_done", "n_total", F.round(100.0 * F.col("n_done") / F.col("n_total"), 1).alias("pct"), "next_start")


def first_missing(cases: DataFrame, done: DataFrame, n: int = 5) -> DataFrame:
    return resume_todo(cases.select("case_id", "row_idx"), done).orderBy("row_idx").limit(n)


def merge(cases: DataFrame, done: DataFrame) -> DataFrame:
    """Every case with its record's report, or its template as a placeholder where there is no record."""
    found = done.select("case_id", F.struct(F.col("report")).alias("record"))
    out = cases.select("row_idx", "case_id", "template_content").join(found, "case_id", "left")
    return out.select("row_idx", "case_id", F.when(F.col("record").isNull(), F.col("template_content")).otherwise(F.col("record.report")).alias("report"), F.col("record").isNull().alias("is_placeholder"))


def require_complete(cases: DataFrame, done: DataFrame, allow_partial: bool = False) -> None:
    """Raises if cases lack records, naming the first of them."""
    if not allow_partial and (missing := first_missing(cases, done).collect()):
        raise ValueError(f"cases without a record, first: {[r.case_id for r in missing]}")


def merge_counts(cases: DataFrame, done: DataFrame) -> DataFrame:
    """Rows, generated and placeholder reports of the merge, and invalid records of the whole shard."""
    merged = merge(cases, done).agg(
        F.count("*").alias("n_rows"), F.count_if(~F.col("is_placeholder")).alias("n_generated"), F.count_if("is_placeholder").alias("n_placeholder")
    )
    invalid = done.agg(F.count_if(~F.coalesce("valid", F.lit(True))).alias("n_invalid"))
    return merged.join(invalid, F.lit(True))  # one row each
