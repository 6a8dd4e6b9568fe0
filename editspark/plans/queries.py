"""The registered queries: every operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import report as R
from ..functions import text as T
from ..functions.metric import edit_cost, edit_distance
from ..operators import batch, evaluate, retrieve, sketch
from ..sources.files import last_records
from ..sources.scratch import spread
from . import crossval, generate, prompts
from . import fixtures as X


def r6(c) -> Column:
    return F.round(c, 6)


def long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def scan_cases(s: SparkSession, d: str) -> DataFrame:
    return X.cases(s, d).select("case_id", "row_idx", "modality", "body_part", long(F.length("report")).alias("n_chars"))


def shard_last_wins(s: SparkSession, d: str) -> DataFrame:
    return last_records(X.records(s, d)).select("case_id", "first_ordinal", "ordinal", "res", "valid")


def slice_window(s: SparkSession, d: str) -> DataFrame:
    return batch.slice_window(X.targets(s, d), 50, 60).select("case_id", "row_idx")


def resume_todo(s: SparkSession, d: str) -> DataFrame:
    return batch.resume_todo(X.targets(s, d), last_records(X.records(s, d))).select("case_id", "row_idx")


def batch_status(s: SparkSession, d: str) -> DataFrame:
    return batch.batch_status(X.targets(s, d), last_records(X.records(s, d)))


def merge_submission(s: SparkSession, d: str) -> DataFrame:
    return batch.merge(X.targets(s, d), last_records(X.records(s, d))).select("case_id", "report", "is_placeholder")


def merge_counts(s: SparkSession, d: str) -> DataFrame:
    return batch.merge_counts(X.targets(s, d), last_records(X.records(s, d)))


def _documents(s: SparkSession, d: str) -> DataFrame:
    return spread(X.table(s, d, "documents").select("doc_id", "text"))


def normalize_text(s: SparkSession, d: str) -> DataFrame:
    return _documents(s, d).select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


def tokenize(s: SparkSession, d: str) -> DataFrame:
    return _documents(s, d).select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token")).withColumn("pos", long("pos"))


def token_weights(s: SparkSession, d: str) -> DataFrame:
    tokens = _documents(s, d).select("doc_id", T.tokens(F.col("text")).alias("t"))
    w = tokens.select("doc_id", "t", F.transform("t", T.token_weight).alias("w"))
    return w.select(
        "doc_id", long(F.size("t")).alias("n_tokens"), F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("sum_weight"),
        long(F.size(F.filter("w", lambda x: x == 4))).alias("n_critical"), long(F.size(F.filter("w", lambda x: x == 0.25))).alias("n_function"),
    )


def _exploded(rows: DataFrame, fields: Column, impression: Column) -> DataFrame:
    out = rows.select("case_id", F.posexplode(fields).alias("pos", "f"), impression.alias("impression"))
    return out.select("case_id", long("pos").alias("pos"), "f.key", "f.value", "impression")


def parse_fields(s: SparkSession, d: str) -> DataFrame:
    rows = X.cases(s, d).select("case_id", R.parse(F.col("report")).alias("p"))
    return _exploded(rows, F.col("p.fields"), F.col("p.impression"))


def template_signature(s: SparkSession, d: str) -> DataFrame:
    return X.cases(s, d).select("case_id", F.array_join(R.signature(R.parse(F.col("template_content")).fields), "|").alias("signature"))


def _deltas(s: SparkSession, d: str) -> DataFrame:
    rows = evaluate.parsed(X.cases(s, d))
    return rows.select("case_id", "tmpl", R.changed_fields(F.col("tmpl"), F.col("ref")).alias("updates"), F.col("ref.impression").alias("impression"))


def delta_extract(s: SparkSession, d: str) -> DataFrame:
    rows = _deltas(s, d)
    return _exploded(rows, F.col("updates"), F.col("impression"))


def render_report(s: SparkSession, d: str) -> DataFrame:
    """Each report's changes applied to its template, with one update of a field no template has."""
    extra = F.array(F.struct(F.lit(" other findings ").alias("key"), F.concat(F.lit(" see "), F.col("case_id")).alias("value")))
    return _deltas(s, d).select("case_id", R.render(F.col("tmpl"), F.concat("updates", extra), F.col("impression")).alias("report"))


def decode_delta(s: SparkSession, d: str) -> DataFrame:
    rows = X.responses(s, d).select("case_id", generate.decode(F.col("raw_response")).alias("d"))
    out = rows.select("case_id", F.when(F.col("d.ok"), "ok").otherwise("undecodable").alias("status"), F.explode_outer("d.updates").alias("u"), F.col("d.impression").alias("impression"))
    return out.select("case_id", "status", "u.key", "u.value", "impression")


def validate_structure(s: SparkSession, d: str) -> DataFrame:
    """Every report against the template of the next case by number, so that fields are missing."""
    c = X.cases(s, d)
    other = c.select((F.col("row_idx") - 1).alias("row_idx"), F.col("template_content").alias("other"))
    rows = c.join(other, "row_idx", "left").withColumn("issues", R.structure_issues(F.col("report"), F.coalesce("other", "template_content")))
    return rows.select("case_id", (F.size("issues") == 0).alias("is_valid"), F.array_join("issues", "; ").alias("issues"))


def _with_lengths(c: DataFrame) -> Column:
    """The dictation and, as the tables have few lengths, one made from the case's number."""
    return F.concat(F.col("dictation"), F.lit(". Right "), (F.col("row_idx") % 9).cast("string"), F.lit(".5 cm and 12mm, left 3 mm"))


def validate_fidelity(s: SparkSession, d: str) -> DataFrame:
    c = X.cases(s, d)
    w = c.select("case_id", R.fidelity_warnings(_with_lengths(c), F.concat("report", F.lit(" 12mm bright"))).alias("w"))
    return w.select("case_id", (F.size("w") == 0).alias("is_faithful"), long(F.size("w")).alias("n_warnings"))


def measurements(s: SparkSession, d: str) -> DataFrame:
    c = X.cases(s, d)
    return c.select("case_id", F.posexplode(T.measurements(_with_lengths(c))).alias("pos", "measurement")).withColumn("pos", long("pos"))


def weighted_edit(s: SparkSession, d: str) -> DataFrame:
    rows = evaluate.parsed(X.cases(s, d))
    pairs = rows.select("case_id", F.explode(R.as_dict(F.col("ref.fields"))).alias("f"), "pred")
    pairs = pairs.select("case_id", "f.key", T.tokens(F.col("f.value")).alias("a"), R.last_value(F.col("pred.fields"), F.col("f.key")).alias("v")).filter("v is not null")
    pairs = pairs.withColumn("b", T.tokens(F.col("v")))
    return pairs.select("case_id", "key", edit_cost(F.col("a"), F.col("b")).alias("cost"), r6(edit_distance(F.col("a"), F.col("b"))).alias("distance"))


def res_fields(s: SparkSession, d: str) -> DataFrame:
    return evaluate.scored_fields(evaluate.parsed(X.cases(s, d))).withColumn("edit", r6("edit"))


def res_findings(s: SparkSession, d: str) -> DataFrame:
    return evaluate.findings_scores(evaluate.scored_fields(evaluate.parsed(X.cases(s, d)))).select("case_id", r6("findings_score").alias("findings_score"))


def res_scores(s: SparkSession, d: str) -> DataFrame:
    return evaluate.report_scores(X.cases(s, d)).select("case_id", *(r6(c).alias(c) for c in ("res_case", "findings_score", "impression_score")))


def res_by_modality(s: SparkSession, d: str) -> DataFrame:
    return evaluate.by_modality(evaluate.report_scores(X.cases(s, d), "modality"), "res_case").withColumn("mean_res", r6("mean_res"))


def _corpus(s: SparkSession, d: str, *columns: str, hashed: bool = False) -> DataFrame:
    return retrieve.corpus(X.corpus(s, d), "row_idx", *columns, hashed=hashed)


def _questions(s: SparkSession, d: str, *columns: str, hashed: bool = False) -> DataFrame:
    return retrieve.corpus(X.questions(s, d), "row_idx", *columns, hashed=hashed)


def _loo(s: SparkSession, d: str, *columns: str, hashed: bool = False) -> DataFrame:
    return retrieve.corpus(X.cases(s, d), "row_idx", *columns, hashed=hashed)


def bm25_index(s: SparkSession, d: str) -> DataFrame:
    return retrieve.bm25_index(_corpus(s, d, "tokens")).withColumn("idf", r6("idf"))


def bm25_scores(s: SparkSession, d: str) -> DataFrame:
    return retrieve.bm25_scores(_questions(s, d, "tokens"), _corpus(s, d, "tokens", "length")).withColumn("score", r6("score"))


def tfidf_index(s: SparkSession, d: str) -> DataFrame:
    return retrieve.tfidf_index(_corpus(s, d, "terms")).withColumn("idf", r6("idf"))


def tfidf_scores(s: SparkSession, d: str) -> DataFrame:
    return retrieve.tfidf_scores(_questions(s, d, "terms"), _corpus(s, d, "terms")).withColumn("cosine", r6("cosine"))


def jaccard_sig(s: SparkSession, d: str) -> DataFrame:
    c = _loo(s, d, "headers")
    return retrieve.header_scores(c, c).withColumn("jaccard", r6("jaccard"))


def hybrid_topk(s: SparkSession, d: str) -> DataFrame:
    best = sketch.best_of_texts(X.questions(s, d), X.corpus(s, d), "row_idx")
    return best.select("query_id", long("rank").alias("rank"), "doc_id", r6("score").alias("score"))


def hybrid_topk_loo(s: SparkSession, d: str) -> DataFrame:
    c = _loo(s, d, hashed=True)
    best = retrieve.best(c, c, exclude_self=True)
    return best.select("query_id", long("rank").alias("rank"), "doc_id", r6("score").alias("score"))


def sentence_split(s: SparkSession, d: str) -> DataFrame:
    return X.cases(s, d).select("case_id", F.posexplode(T.sentences(F.col("dictation"))).alias("pos", "sentence")).withColumn("pos", long("pos"))


def heuristic_route(s: SparkSession, d: str) -> DataFrame:
    rows = X.cases(s, d).withColumn("tmpl", R.parse(F.col("template_content")))
    rows = rows.withColumn("r", R.routed(F.col("tmpl.fields"), F.col("tmpl.impression"), F.col("dictation")))
    out = rows.select("case_id", F.explode_outer("r.updates").alias("u"), F.col("r.impression").alias("impression"))
    return out.select("case_id", "u.key", "u.value", "impression")


def stage1_reports(s: SparkSession, d: str) -> DataFrame:
    return generate.routed_reports(X.cases(s, d))


def prompt_stage1(s: SparkSession, d: str) -> DataFrame:
    return X.cases(s, d).select("case_id", prompts.stage1_prompt().alias("prompt"))


def prompt_build(s: SparkSession, d: str) -> DataFrame:
    c = X.cases(s, d)
    return prompts.build_prompts(c, retrieve.retrieve(c, c, exclude_self=True))


def rag_with_fallback(s: SparkSession, d: str) -> DataFrame:
    return generate.reports(X.cases(s, d), X.responses(s, d)).select("case_id", "report", "source")


def rag_strict(s: SparkSession, d: str) -> DataFrame:
    return generate.reports(X.cases(s, d), X.responses(s, d), strict=True).select("case_id", "status")


def stratified_folds(s: SparkSession, d: str) -> DataFrame:
    return evaluate.stratified_folds(X.strata(s, d)).select("doc_id", long("fold").alias("fold"))


def cv_fold_means(s: SparkSession, d: str) -> DataFrame:
    m = evaluate.fold_means(crossval.cross_validated(X.cases(s, d)))
    return m.select(long("fold").alias("fold"), "n", *(r6(c).alias(c) for c in ("mean_res", "mean_findings", "mean_impression")))


def cv_summary(s: SparkSession, d: str) -> DataFrame:
    m = evaluate.overall(crossval.cross_validated(X.cases(s, d)))
    return m.select(*(r6(c).alias(c) for c in ("overall_res", "overall_findings", "overall_impression")), "validation_failures", "total_cases")


def score_summary(s: SparkSession, d: str) -> DataFrame:
    m = evaluate.score_summary(last_records(X.records(s, d)))
    return m.select(*(r6(c).alias(c) for c in ("mean_res", "median_res", "std_res")), "validation_failures", "cases_scored")


def shard_by_modality(s: SparkSession, d: str) -> DataFrame:
    return evaluate.by_modality(last_records(X.records(s, d))).withColumn("mean_res", r6("mean_res"))


def worst_cases(s: SparkSession, d: str) -> DataFrame:
    return evaluate.worst(last_records(X.records(s, d))).select("case_id", "res", "modality")


def submission_reports(s: SparkSession, d: str) -> DataFrame:
    """Reports for all cases without a model, as the submission table has them."""
    none = s.createDataFrame([], "case_id string, raw_response string")
    return generate.reports(X.cases(s, d), none).select("case_id", "report")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        scan_cases, shard_last_wins, slice_window, resume_todo, batch_status, merge_submission, merge_counts, normalize_text, tokenize, token_weights,
        parse_fields, template_signature, render_report, delta_extract, decode_delta, validate_structure, validate_fidelity, measurements, weighted_edit,
        res_fields, res_findings, res_scores, res_by_modality, bm25_index, bm25_scores, tfidf_index, tfidf_scores, jaccard_sig, hybrid_topk, hybrid_topk_loo,
        sentence_split, heuristic_route, stage1_reports, prompt_stage1, prompt_build, rag_with_fallback, rag_strict, stratified_folds, cv_fold_means, cv_summary,
        score_summary, shard_by_modality, worst_cases, submission_reports,
    )
    return {f.__name__: f for f in named}
