"""The jobs as registered queries: each runs its function twice over whole tables into one new folder, and returns the output as it stands then."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editspark.operators import index
from editspark.plans import oracle
from editspark.sources.scratch import shared_dir

from .evaluate import evaluate
from .index_documents import index_documents


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/editspark-{name}-{uuid.uuid4().hex}"


def job1_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all cases and their summaries by fold, by modality and over all."""
    target = _folder(spark, "job1")
    for _ in range(2):
        out = evaluate(spark, f"{sf_dir}/conversations.parquet", target)
    return out.withColumns({"fold": F.col("fold").cast("string"), **{c: F.round(c, 6) for c in ("mean_res", "mean_findings", "mean_impression")}})


def job2_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the index's three tables, statistics added up: postings, documents' lengths and tokens' numbers of documents."""
    target = _folder(spark, "job2")
    for _ in range(2):
        index_documents(spark, f"{sf_dir}/documents.parquet", target, f"{target}/checkpoint")
    postings, documents = index.table(spark, target, "postings"), index.table(spark, target, "documents")
    none, kind = F.lit(None), lambda name: F.lit(name).alias("kind")
    rows = postings.select(kind("posting"), "token", F.col("id").cast("string").alias("doc_id"), F.col("tf").alias("n"))
    rows = rows.union(documents.select(kind("document"), none.cast("string"), F.col("id").cast("string"), "length"))
    return rows.union(index.statistics(spark, target).select(kind("token"), "token", none.cast("string"), "df"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_evaluate, job2_index_documents)}


def oracle_sql() -> dict[str, str]:
    means = ", ".join(f"round(avg({c}), 6) AS mean_{name}" for c, name in (("res_case", "res"), ("findings_score", "findings"), ("impression_score", "impression")))
    return {
        "job1_evaluate": oracle.with_tables(f"""SELECT CASE WHEN grouping(case_id) = 0 THEN 'case' WHEN grouping(fold) = 0 THEN 'fold' WHEN grouping(modality) = 0 THEN 'modality' ELSE 'all' END AS level,
            case_id, fold::VARCHAR AS fold, modality, count(*) AS cases, count(*) FILTER (NOT valid) AS invalid, {means} FROM cv GROUP BY GROUPING SETS ((case_id, fold, modality), (fold), (modality), ()) HAVING count(*) > 0"""),
        "job2_index_documents": oracle.with_tables("""SELECT 'document' AS kind, NULL::VARCHAR AS token, doc_id::VARCHAR AS doc_id, len(toks) AS n FROM doc_tokens
            UNION ALL SELECT 'posting', token, doc_id::VARCHAR, count(*) FROM (SELECT doc_id, unnest(toks) AS token FROM doc_tokens) GROUP BY token, doc_id
            UNION ALL SELECT 'token', token, NULL, count(*) FROM (SELECT DISTINCT doc_id, unnest(toks) AS token FROM doc_tokens) GROUP BY token"""),
    }
