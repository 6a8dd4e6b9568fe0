"""The engine's text functions and tables by name in Spark SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report as R
from . import text as T

#: Temporary views made from a table of cases: name and columns beside ``case_id``.
VIEWS = {
    "case_fields": lambda c: c.select("case_id", F.posexplode(R.parse(F.col("report")).fields).alias("pos", "f")).select("case_id", "pos", "f.key", "f.value"),
    "case_tokens": lambda c: c.select("case_id", F.posexplode(T.tokens(F.col("report"))).alias("pos", "token")),
    "case_sentences": lambda c: c.select("case_id", F.posexplode(T.sentences(F.col("dictation"))).alias("pos", "sentence")),
}


def register_views(cases: DataFrame) -> list[str]:
    """Makes ``case_fields``, ``case_tokens`` and ``case_sentences`` of a table of cases, as expressions that the optimiser sees through."""
    for name, view in VIEWS.items():
        view(cases).createOrReplaceTempView(name)
    return list(VIEWS)


def register_functions(spark: SparkSession) -> list[str]:
    """SQL functions ``es_standard_unit(token)``, ``es_token_weight(token)``, ``es_capitalize(text)`` and ``es_measurements(text)``, JVM-side.

    They are SQL expressions under a name, so they cost nothing beside their expression.
    """
    made = {
        "es_token_weight": ("t STRING", "DOUBLE", T.token_weight),
        "es_standard_unit": ("t STRING", "STRING", T.standard_unit),
        "es_capitalize": ("t STRING", "STRING", T.capitalize),
        "es_measurements": ("t STRING", "ARRAY<STRING>", T.measurements),
    }
    for name, (argument, kind, f) in made.items():
        probe = spark.createDataFrame([], argument.lower()).select(f(F.col("t")).alias("x"))
        expression = probe._jdf.queryExecution().analyzed().expressions().head().child().sql().replace("`t`", "t")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({argument}) RETURNS {kind} RETURN {expression}")
    return list(made)
