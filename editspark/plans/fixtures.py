"""The driver's tables seen as the engine's inputs: cases, shards, targets, strata, corpus and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases_of(table(spark, sf_dir, "conversations"))


def cases_of(conversations: DataFrame) -> DataFrame:
    """One case a conversation: turns become fields, first and last turns impressions, user turns the dictation.

    The report has whole turns. In the template assistant turns, and in the prediction every other of them and the impression, lack every seventh word.
    """
    turns = conversations.select(
        "conv_id", "turn", "role",
        F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "").alias("w"),
        F.rtrim(F.concat(F.lit("T"), F.col("turn").cast("string"), F.lit(" "), F.upper(F.regexp_extract("text", "[A-Za-z]{4,}", 0)))).alias("k"),
    )
    t = F.array_sort(F.collect_list(F.struct("turn", "role", "k", "w")))
    g = turns.groupBy("conv_id").agg(t.alias("t"))
    first, last = F.get("t", F.lit(0)), F.element_at("t", -1)

    def whole(w):
        return F.array_join(w, " ")

    def thinned(w):
        return F.array_join(F.filter(w, lambda _, i: i % 7 != 3), " ")

    def findings(changed):
        return F.array_join(F.transform("t", lambda x: F.concat(x.k, F.lit(": "), F.when(changed(x), thinned(x.w)).otherwise(whole(x.w)))), "\n")

    def report(body, impression):
        return F.concat(F.lit("FINDINGS:\n"), body, F.lit("\n\nIMPRESSION:\n"), impression)

    said = F.transform(F.filter("t", lambda x: x.role == "user"), lambda x: whole(x.w))
    modality, part = F.upper(first.role), F.concat(F.lit("B"), (F.col("conv_id") % 7).cast("string"))
    return g.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("case_id"), F.col("conv_id").cast("long").alias("row_idx"),
        modality.alias("modality"), part.alias("body_part"), F.concat(modality, F.lit(" "), part).alias("study_description"),
        F.lit("").alias("patient_age_band"), F.lit("").alias("patient_sex"),
        report(findings(lambda x: x.role == "assistant"), whole(first.w)).alias("template_content"),
        F.array_join(said, ". ").alias("dictation"),
        report(findings(lambda x: F.lit(False)), whole(last.w)).alias("report"),
        report(findings(lambda x: (x.role == "assistant") & (x.turn % 2 == 1)), thinned(last.w)).alias("predicted"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("case_id"), F.col("doc_id").alias("row_idx"), F.col("lang").alias("modality"), F.col("source").alias("body_part"),
        F.concat_ws(" ", "lang", "source").alias("study_description"), F.lit("").alias("template_content"), F.col("text").alias("dictation"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").cast("string").alias("case_id"), F.col("item_id").alias("row_idx"), F.col("text").alias("dictation"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard records in event order: one case a user."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("case_id"), F.col("event_id").alias("ordinal"), F.col("value").alias("res"), F.col("event_type").alias("modality"),
        (F.col("event_type") != "error").alias("valid"), F.col("props").alias("report"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("case_id"), F.col("c_custkey").cast("long").alias("row_idx"), F.col("c_mktsegment").alias("template_content"))


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("row_idx"), F.col("lang").alias("modality"), F.col("source").alias("body_part"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replayed model answer for each case, of six kinds in turn: usable, malformed, an array, a value that isn't text, null fields, fields missing."""
    kind = F.col("row_idx") % 6
    usable = F.to_json(F.struct(F.create_map(F.lit("OTHER"), F.col("dictation")).alias("field_updates"), F.lit("seen").alias("impression")))
    raw = (
        F.when(kind == 0, usable).when(kind == 1, F.concat(F.lit("{"), F.col("dictation"))).when(kind == 2, F.lit("[1, 2]"))
        .when(kind == 3, F.lit('{"field_updates": {"A": 3}, "impression": "x"}')).when(kind == 4, F.lit('{"field_updates": null, "impression": "x"}'))
        .otherwise(F.lit('{"impression": "only this"}'))
    )
    return cases(spark, sf_dir).select("case_id", raw.alias("raw_response"))
