"""The report edit score, folds and grouped summaries."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C
from ..functions import report as R
from ..functions.binding import bound
from ..functions.metric import compared
from ..functions.text import text_or_empty
from ..sources.scratch import written

FOLDS = 5
#: Row numbers ranked together.
RUN = 100_000
#: Distinct values that one task ranks at most, and ranges that more are cut into.
FEW, SPLITS = 20_000, 64


def _edits(cases: DataFrame, more: tuple[str, ...] = (), impressions: bool = False) -> DataFrame:
    """``case_id``, the named columns, ``key, is_field, weight, edit`` of every field of ``report`` and ``predicted`` and, if asked, of the impression, from ``ref``, ``pred`` and ``tmpl``.

    Fields meet within their case's row: an array of the keys of both, each looked up in the three parsed reports, so nothing is shuffled.
    """

    def pair(key: Column, ref: Column, pred: Column, tmpl: Column, is_field: bool) -> Column:
        return F.struct(key.alias("key"), ref.alias("ref"), pred.alias("pred"), tmpl.alias("tmpl"), F.lit(is_field).alias("is_field"))

    def met(x: Column) -> Column:
        keys = F.array_union(R.field_keys(x.ref.fields), R.field_keys(x.pred.fields))
        last = lambda c, k: R.last_value(c.fields, k)
        fields = F.transform(keys, lambda k: pair(k, last(x.ref, k), last(x.pred, k), F.coalesce(last(x.tmpl, k), F.lit("")), True))
        return F.concat(fields, F.array(pair(F.lit(""), text_or_empty(x.ref.impression), text_or_empty(x.pred.impression), F.lit(""), False))) if impressions else fields

    rows = bound(F.struct("ref", "pred", "tmpl"), met)
    exploded = cases.select("case_id", *more, F.explode(rows).alias("f")).select("case_id", *more, "f.*")
    met_texts = exploded.withColumn("met", compared(F.col("ref"), F.col("pred"), F.col("tmpl")))
    weight = F.when(F.col("ref").isNull(), C.UNEXPECTED).when(F.col("met.changed"), C.CHANGED).otherwise(C.UNCHANGED)
    return met_texts.select("case_id", *more, "key", "is_field", weight.alias("weight"), "met.edit")


def scored_fields(cases: DataFrame) -> DataFrame:
    """``case_id, key, weight, edit`` of every field of ``report`` and ``predicted``, from parsed columns ``ref``, ``pred`` and ``tmpl``."""
    return _edits(cases).drop("is_field")


def parsed(cases: DataFrame) -> DataFrame:
    """Adds ``ref``, ``pred`` and ``tmpl``: each text of a case parsed once."""
    return cases.withColumns({"ref": R.parse(F.col("report")), "pred": R.parse(F.col("predicted")), "tmpl": R.parse(F.col("template_content"))})


def findings_scores(fields: DataFrame) -> DataFrame:
    """The weighted mean edit of each case that has fields."""
    return fields.groupBy("case_id").agg((F.sum(F.col("weight") * F.col("edit")) / F.sum("weight")).alias("findings_score"))


def report_scores(cases: DataFrame, *more: str) -> DataFrame:
    """``case_id``, the named columns, ``res_case, findings_score, impression_score`` of cases with ``report, predicted, template_content``; 0 is best.

    Cases are read once: the impression is one more pair of texts beside the fields, and what is shuffled is a case's sums.
    """
    of_field, weighted = F.col("is_field"), F.col("weight") * F.col("edit")
    sums = _edits(parsed(cases), more, impressions=True).groupBy("case_id", *more).agg(
        F.sum(F.when(of_field, weighted)).alias("edits"), F.sum(F.when(of_field, F.col("weight"))).alias("weights"), F.max(F.when(~of_field, F.col("edit"))).alias("impression_score")
    )
    out = sums.withColumn("findings_score", F.coalesce(F.col("edits") / F.col("weights"), F.lit(0.0)))
    res = C.FINDINGS_SHARE * F.col("findings_score") + C.IMPRESSION_SHARE * F.col("impression_score")
    return out.select("case_id", *more, res.alias("res_case"), "findings_score", "impression_score")


def stratum(modality: Column, body_part: Column) -> Column:
    """One joined key: ``a_b`` with ``c`` and ``a`` with ``b_c`` are one stratum."""
    return F.concat_ws("_", F.coalesce(modality, F.lit("")), F.coalesce(body_part, F.lit("")))


def stratified_folds(cases: DataFrame, folds: int = FOLDS, order: str = "row_idx") -> DataFrame:
    """Adds ``fold``: the position in the stratum, in row order, modulo the number of folds.

    Positions are ranks within a stratum. ``order`` holds whole numbers; a stratum is ranked in runs of ``RUN`` of them, each starting at the number of
    rows before it, so that a hot stratum isn't sorted in one task.
    """
    keyed = cases.withColumns({"_stratum": stratum(F.col("modality"), F.col("body_part")), "_run": F.floor(F.col(order) / RUN)})
    sizes = keyed.groupBy("_stratum", "_run").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_stratum").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_stratum", "_run", before.alias("_before"))
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("_stratum", "_run").orderBy(order)))
    return ranked.join(starts, ["_stratum", "_run"]).withColumn("fold", ((F.col("_before") + F.col("_rank") - 1) % folds).cast("int")).drop("_stratum", "_run", "_rank", "_before")


def fold_means(scores: DataFrame) -> DataFrame:
    """Means of each fold that has cases."""
    return scores.groupBy("fold").agg(
        F.count("*").alias("n"), F.avg("res_case").alias("mean_res"), F.avg("findings_score").alias("mean_findings"), F.avg("impression_score").alias("mean_impression")
    )


def overall(scores: DataFrame) -> DataFrame:
    """Means over all cases, not over folds, and how many reports are invalid."""
    return scores.agg(
        F.avg("res_case").alias("overall_res"), F.avg("findings_score").alias("overall_findings"), F.avg("impression_score").alias("overall_impression"),
        F.count_if(~F.col("valid")).alias("validation_failures"), F.count("*").alias("total_cases"),
    )


def median(rows: DataFrame, column: str) -> DataFrame:
    """One row, ``median``: exact, of the values that aren't null; none if there are none.

    Distinct values are counted and written. While more than ``FEW`` of them may hold the middle ranks, ``SPLITS`` values that occur, approximate quantiles of those, cut them into ranges of
    like numbers of distinct values whatever their sizes, and the ranges' counts say which to go on with. Only numbers of ranges come to the driver.
    """
    some = written(rows.select(F.col(column).cast("double").alias("x")).filter("x is not null").groupBy("x").agg(F.count("*").alias("c")), "values")
    at = some.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("distinct")).first()
    ranks, before, distinct = ((at.n - 1) // 2, at.n // 2), 0, at.distinct
    while distinct > FEW:
        cuts = sorted(set(some.agg(F.percentile_approx("x", [k / SPLITS for k in range(1, SPLITS)], 10 * SPLITS)).first()[0]))
        of_range = F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda k, cut: k + (F.col("x") > cut).cast("int"))
        ranged = some.withColumn("r", of_range)
        sizes = sorted(ranged.groupBy("r").agg(F.sum("c").alias("c"), F.count("*").alias("distinct")).collect())  # SPLITS rows
        ends = list(itertools.accumulate(r.c for r in sizes))
        first, last = (next(k for k, end in enumerate(ends) if before + end > rank) for rank in ranks)
        kept = sum(r.distinct for r in sizes[first : last + 1])
        if kept == distinct:
            break
        before, distinct = before + (ends[first - 1] if first else 0), kept
        some = written(ranged.filter(F.col("r").between(sizes[first].r, sizes[last].r)).select("x", "c"), "values")
    upto = some.withColumn("upto", before + F.sum("c").over(Window.orderBy("x")))  # few rows
    middle = [F.min(F.when(F.col("upto") > rank, F.col("x"))) for rank in ranks]
    return upto.agg((0.5 * (middle[0] + middle[1])).alias("median")).filter("median is not null")


def score_summary(records: DataFrame) -> DataFrame:
    """Mean, median and population deviation of scores; no row for no record."""
    out = records.agg(
        F.avg("res").alias("mean_res"), F.stddev_pop("res").alias("std_res"),
        F.count_if(~F.coalesce("valid", F.lit(True))).alias("validation_failures"), F.count("*").alias("cases_scored"),
    ).filter("cases_scored > 0")
    both = out.join(F.broadcast(median(records, "res")), F.lit(True), "left")  # one row each
    return both.select("mean_res", F.col("median").alias("median_res"), "std_res", "validation_failures", "cases_scored")


def by_modality(records: DataFrame, score: str = "res") -> DataFrame:
    """Number and mean score of each modality (``?`` where it is missing), worst first."""
    return records.groupBy(F.coalesce("modality", F.lit("?")).alias("modality")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_res")).orderBy(F.desc("mean_res"), "modality")


def worst(records: DataFrame, k: int = 10) -> DataFrame:
    """The k records of highest score; ties in the order of their first records."""
    return records.orderBy(F.desc("res"), "first_ordinal").limit(k)
