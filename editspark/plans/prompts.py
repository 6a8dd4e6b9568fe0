"""Prompts: fixed text around a case's columns; few-shot examples as JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import report as R
from ..sources.schemas import UPDATES

# Fixed value: the instruction sent with every prompt.
SYSTEM_EXAMPLES = """You are an expert radiologist assistant. Your task is to convert radiologist dictation into a minimally edited, template-complete report.

Core Rules:
1. Treat template_content as the baseline starting report.
2. Route dictated findings to the matching template field label (e.g. LUNGS, PLEURA, BONES, etc.).
3. Replace or modify normal statements ONLY when dictation describes an abnormality in that field.
4. Keep template statements unchanged for routinely visualized regions NOT mentioned in dictation.
5. Update IMPRESSION to concisely summarize important abnormal findings.
6. Preserve exact wording, laterality (right/left), severity, and numerical measurements (mm/cm).

Return your response strictly as valid JSON matching this schema:
{
  "field_updates": {
    "FIELD_KEY": "Updated sentence replacing normal statement"
  },
  "impression": "Concise clinical summary"
}
"""
# The lines of the two prompts.
_STAGE1 = [
    ("Case Information:\nModality: ", "modality"),
    ("\nBody Part: ", "body_part"),
    ("\nStudy Description: ", "study_description"),
    ("\nPatient Age Band: ", "patient_age_band"),
    ("\nPatient Sex: ", "patient_sex"),
    ("\n\nNormal Template:\n", "template_content"),
    ("\n\nDictation:\n", "dictation"),
]
_STAGE1_END = "\n\nRespond with valid JSON containing field_updates and impression:"
_HEAD = "Below are examples showing how past dictations were incorporated into templates:\n\n"
_EXAMPLE = "--- EXAMPLE {n} ---\nModality: {modality} | Body Part: {body_part}\nTemplate:\n{template_content}\n\nDictation:\n{dictation}\n\nExpected Report Updates (JSON):\n{updates}\n\n"
_TARGET = "=== TARGET CASE TO PROCESS ===\nModality: {modality} | Body Part: {body_part}\nStudy Description: {study_description}\nTemplate:\n{template_content}\n\nDictation:\n{dictation}\n\nGenerate the target case field_updates and impression strictly in valid JSON format:"


def stage1_prompt() -> Column:
    """From a case's columns, none of them null."""
    return F.concat(*(x for text, column in _STAGE1 for x in (F.lit(text), F.col(column))), F.lit(_STAGE1_END))


def example(case: Column) -> Column:
    """What a prompt shows of a past case, with the changes its report made to its template."""
    template, report = R.parse(case.template_content), R.parse(case.report)
    return F.struct(
        *(case.getField(c).alias(c) for c in ("modality", "body_part", "template_content", "dictation")),
        R.changed_fields(template, report).cast(UPDATES).alias("updates"), report.impression.alias("impression"),
    )


def build_prompts(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``case_id, prompt`` of every case with the examples of ``retrieved(query_id, examples)``, none where it has none.

    The layout of the examples' JSON must be exact to the byte, which Spark's writer isn't: an Arrow batch function writes it.
    """
    shown = retrieved.select(F.col("query_id").alias("case_id"), F.transform("examples", example).alias("shown"))
    columns = ["case_id", "modality", "body_part", "study_description", "template_content", "dictation"]
    rows = cases.select(*columns).join(shown, "case_id", "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            prompts = []
            for case in b.to_dict("records"):
                parts = [_HEAD]
                for n, e in enumerate(case["shown"] if case["shown"] is not None else [], 1):
                    updates = {"field_updates": {u["key"]: u["value"] for u in e["updates"]}, "impression": e["impression"]}
                    parts.append(_EXAMPLE.format_map({**e, "n": n, "updates": json.dumps(updates, indent=2)}))
                parts.append(_TARGET.format_map(case))
                prompts.append("".join(parts))
            yield pd.DataFrame({"case_id": b["case_id"], "prompt": prompts})

    return rows.mapInPandas(write, "case_id string, prompt string")
