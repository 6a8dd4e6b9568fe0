"""Command line: ``python -m editspark run|test|cv|status|score|merge``.

Model answers come from a replay table (``--responses``, JSON lines of ``case_id, raw_response``) or a function of one ``Request``
(``--provider package.module:function``); ``run`` takes neither as well and then reports by rules.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import report as R
from .operators import batch, evaluate, retrieve
from .plans import crossval, generate, prompts
from .session import session
from .sources import files
from .sources.schemas import CASES, TRAIN
from .sources.scratch import written


def _cases(spark: SparkSession, path: str, train: bool) -> DataFrame:
    return files.read_cases(spark, path, TRAIN if train else CASES)


def _done(spark: SparkSession, shard: str) -> DataFrame:
    return files.last_records(files.read_shard(spark, shard))


def _provider(name: str) -> generate.Provider:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _records(todo: DataFrame, answers: DataFrame, is_cv: bool) -> DataFrame:
    """Shard records of the cases with a usable answer."""
    made = generate.reports(todo, answers, strict=True).filter("status = 'ok'").select("case_id", F.col("report").alias("made"))
    rows = todo.join(made, "case_id").withColumn("valid", F.size(R.structure_issues(F.col("made"), F.col("template_content"))) == 0)
    if not is_cv:
        return rows.select("case_id", F.col("made").alias("report"), "valid")
    scores = evaluate.report_scores(rows.withColumn("predicted", F.col("made")), "modality", "body_part", "valid", "made")
    return scores.select("case_id", F.col("made").alias("report"), "valid", F.col("res_case").alias("res"), F.col("findings_score").alias("findings"), F.col("impression_score").alias("impression"), "modality", "body_part")


def _asked_one_by_one(spark: SparkSession, args: argparse.Namespace, todo: DataFrame, train: DataFrame, is_cv: bool) -> int:
    """Calls the provider for case after case, ``--sleep`` seconds apart, and appends the records of every ``--save-every`` answers; stops where it gives nothing."""
    provider, settings = _provider(args.provider), generate.Settings().overridden(args.api_key, args.model)
    try:
        generate.preflight(provider, settings)
    except generate.QuotaExhausted as e:
        print(e)
        return 1
    retrieved = retrieve.retrieve(todo, train, args.top_k, exclude_self=is_cv)
    asked = prompts.build_prompts(todo, retrieved).join(retrieved.select(F.col("query_id").alias("case_id"), F.lit(True).alias("has")), "case_id", "left")
    asked = asked.join(todo.select("case_id", "row_idx"), "case_id").orderBy("row_idx").collect()  # --count prompts at most
    held: list[tuple[str, str]] = []

    def save() -> None:
        if held:
            answers = spark.createDataFrame(held, "case_id string, raw_response string")
            files.append_shard(_records(todo.filter(F.col("case_id").isin([c for c, _ in held])), answers, is_cv), args.shard)
            held.clear()

    for n, case in enumerate(asked):
        try:
            if not case.has:
                raise generate.QuotaExhausted("no examples were found")
            held.append((case.case_id, generate.insist(provider, generate.Request(case.prompt, prompts.SYSTEM_EXAMPLES, settings.model, settings.key()), wait_s=args.wait)))
        except generate.QuotaExhausted as e:
            save()
            print(f"stopped at {case.case_id}: {e}")
            return 2
        if len(held) >= args.save_every:
            save()
        if n + 1 < len(asked):
            time.sleep(args.sleep)
    save()
    return 0


def run_slice(spark: SparkSession, args: argparse.Namespace) -> int:
    """Reports for the cases of a slice that have no record, appended to the shard.

    2 if the provider gave nothing for a case, which ends the slice (it is resumed by the same command), or if cases have no usable answer in ``--responses``; 1 if
    the provider doesn't answer at all.
    """
    is_cv = args.command == "cv"
    train = _cases(spark, args.train, True)
    cases = train if is_cv else _cases(spark, args.test, False)
    todo = batch.resume_todo(batch.slice_window(cases, args.start, args.count), _done(spark, args.shard)).cache()
    try:
        n = todo.count()
        if not n:
            print("nothing to do")
            return 0
        if args.provider:
            code = _asked_one_by_one(spark, args, todo, train, is_cv)
        else:
            files.append_shard(_records(todo, spark.read.schema("case_id string, raw_response string").json(args.responses), is_cv), args.shard)
            code = 0
        left = batch.resume_todo(todo, _done(spark, args.shard)).count()
        print(f"{n - left} of {n} cases done")
        return code or (2 if left and not args.provider else 0)
    finally:
        todo.unpersist()


def run_all(spark: SparkSession, args: argparse.Namespace) -> int:
    """Cross-validation over the training cases and the submission for the test cases, in one go; cases without a usable answer are reported by rules."""
    train, test = batch.first_rows(_cases(spark, args.train, True), args.max_cases), _cases(spark, args.test, False)

    def answers(cases: DataFrame, exclude_self: bool) -> DataFrame | None:
        if args.responses:
            return spark.read.schema("case_id string, raw_response string").json(args.responses)
        if not args.provider:
            return None
        asked = prompts.build_prompts(cases, retrieve.retrieve(cases, train, args.top_k, exclude_self))
        settings = generate.Settings().overridden(args.api_key, args.model)
        return written(generate.call_provider(asked, _provider(args.provider), settings, spacing_s=args.sleep), "answers")

    scores = written(crossval.cross_validated(train, answers(train, True)), "scores")
    evaluate.fold_means(scores).orderBy("fold").show(truncate=False)
    summary = evaluate.overall(scores)
    if args.summary:
        files.write_summary(summary, args.summary)
    print(json.dumps(summary.first().asDict()))
    made = written(crossval.generated(test, answers(test, False)).join(test.select("case_id", "row_idx", "template_content"), "case_id"), "submission")
    files.write_submission(made, args.output, not args.parts)
    print("reports with missing parts:", made.filter(F.size(R.structure_issues(F.col("report"), F.col("template_content"))) > 0).count())
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="editspark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "test", "cv", "status", "score", "merge"):
        p = commands.add_parser(name)
        p.add_argument("--train", default="train.csv")
        p.add_argument("--test", default="test.csv")
        if name != "run":
            p.add_argument("--shard", required=True, help="folder of JSON lines")
        if name in ("run", "test", "cv"):
            p.add_argument("--top-k", type=int, default=3)
            p.add_argument("--sleep", type=float, default=4.0, help="seconds between calls")
            p.add_argument("--provider", default="")
            p.add_argument("--responses", default="")
            p.add_argument("--api-key", default="", help="for this run only, before the environment's")
            p.add_argument("--model", default="", help="for this run only")
        if name in ("test", "cv"):
            p.add_argument("--start", type=int, default=0)
            p.add_argument("--count", type=int, default=50)
            p.add_argument("--wait", type=float, default=10.0, help="seconds added to the wait after each call without an answer")
            p.add_argument("--save-every", type=int, default=1, help="answers after which records are appended")
        if name == "run":
            p.add_argument("--max-cases", type=int, default=0)
            p.add_argument("--output", default="submission")
            p.add_argument("--summary", default="")
        if name == "score":
            p.add_argument("--model", default=generate.Settings().model)
            p.add_argument("--output", default="")
        if name == "merge":
            p.add_argument("--output", required=True)
            p.add_argument("--allow-partial", action="store_true")
        if name in ("run", "merge"):
            p.add_argument("--parts", action="store_true", help="ordered part files instead of one file")
    args = parser.parse_args(argv)
    spark = session()
    if args.command == "run":
        return run_all(spark, args)
    if args.command in ("test", "cv"):
        return run_slice(spark, args)
    done = _done(spark, args.shard)
    if args.command == "status":
        batch.batch_status(_cases(spark, args.test, False), done).show(truncate=False)
    elif args.command == "score":
        total = _cases(spark, args.train, True).count()
        means = done.agg(F.avg("findings").alias("overall_findings"), F.avg("impression").alias("overall_impression"))
        whole = evaluate.score_summary(done).join(means, F.lit(True)).withColumns({"train_total": F.lit(total), "model": F.lit(args.model)}).withColumnRenamed("mean_res", "overall_res")
        if args.output:
            files.write_summary(whole, args.output)
        print(json.dumps([r.asDict() for r in whole.collect()], indent=2))
        evaluate.by_modality(done).show(truncate=False)
        evaluate.worst(done).select("case_id", "res", "modality", "body_part").show(truncate=False)
    else:
        cases = _cases(spark, args.test, False)
        batch.require_complete(cases, done, args.allow_partial)
        files.write_submission(batch.merge(cases, done), args.output, not args.parts)
        batch.merge_counts(cases, done).show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
