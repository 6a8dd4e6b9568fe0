"""Cross-validation and submission as single plans: generate, validate, score, fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import report as R
from ..operators import evaluate
from ..sources.scratch import written
from . import generate


def generated(cases: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """``case_id, report`` of every case: from its model response where it is usable, else, and without ``responses``, by rules."""
    if responses is None:
        return generate.routed_reports(cases)
    return generate.reports(cases, responses).select("case_id", "report")


def cross_validated(cases: DataFrame, responses: DataFrame | None = None, folds: int = evaluate.FOLDS) -> DataFrame:
    """Each case's generated report scored against its own: scores, ``valid`` (its structure holds), metadata and ``fold``.

    Folds group results; they hold nothing back. The examples behind a response leave the case itself out (``retrieve(..., exclude_self=True)``).
    """
    kept = ("row_idx", "modality", "body_part", "template_content")
    if responses is None:
        made = generate.routed_reports(cases, *kept, F.col("report").alias("truth")).withColumnsRenamed({"report": "predicted", "truth": "report"})
    else:
        made = cases.select("case_id", *kept, "report").join(generated(cases, responses).withColumnRenamed("report", "predicted"), "case_id")
    valid = F.size(R.structure_issues(F.col("predicted"), F.col("template_content"))) == 0
    scores = evaluate.report_scores(made.withColumn("valid", valid), "row_idx", "modality", "body_part", "valid")
    return evaluate.stratified_folds(written(scores, "scores"), folds)  # read twice, made once
