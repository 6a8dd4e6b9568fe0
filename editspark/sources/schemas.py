"""Row types of the tables the engine reads and makes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


CASES = _strings("case_id", "modality", "body_part", "study_description", "patient_age_band", "patient_sex", "template_content", "dictation")
TRAIN = T.StructType([*CASES.fields, T.StructField("report", T.StringType())])
SHARD = T.StructType(
    [
        T.StructField("case_id", T.StringType()), T.StructField("report", T.StringType()), T.StructField("valid", T.BooleanType()),
        T.StructField("res", T.DoubleType()), T.StructField("findings", T.DoubleType()), T.StructField("impression", T.DoubleType()),
        T.StructField("modality", T.StringType()), T.StructField("body_part", T.StringType()),
    ]
)
UPDATES = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))


def without_nulls(df: DataFrame) -> DataFrame:
    """Every string column's nulls as empty strings: after a source, no operator meets a null string."""
    return df.select(*(F.coalesce(c, F.lit("")).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes))


def defaulted(df: DataFrame, *names: str) -> DataFrame:
    """The named columns as strings, empty where the table lacks the column or the value; other columns stay."""
    return df.withColumns({n: F.coalesce(F.col(n).cast("string"), F.lit("")) if n in df.columns else F.lit("") for n in names})
