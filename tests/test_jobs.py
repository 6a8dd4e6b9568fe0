"""The jobs: against SQL, over growing copies of the input, repeated and after a lost checkpoint, and by their command lines."""

import json
import logging
import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from editspark.operators import index, retrieve
from editspark.plans import fixtures as X
from jobs import evaluate as evaluation
from jobs import registered
from jobs.index_documents import index_documents
from tests.test_queries import DATA, duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_job_equals_sql(spark, duck, name):  # noqa: F811
    before = dict(spark.conf.getAll)
    got, expected = registered.queries()[name](spark, DATA).toPandas(), duck.sql(registered.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
    assert before == dict(spark.conf.getAll)


def everything(spark, path):
    """Each table of an index without the numbers of batches, statistics added up."""
    out = {t: sorted(map(str, index.table(spark, path, t).drop("batch").collect())) for t in ("documents", "postings")}
    return out | {"statistics": sorted((r.token, r.df, round(r.idf, 9)) for r in index.statistics(spark, path).collect()), "mean": index.mean_length(spark, path)}


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The documents in three files."""
    folder = tmp_path_factory.mktemp("parts")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for k in range(3):
        docs.filter(F.pmod("doc_id", F.lit(3)) == k).coalesce(1).write.parquet(f"{folder}/{k}")
    return [next(str(folder / str(k) / f) for f in os.listdir(folder / str(k)) if f.endswith(".parquet")) for k in range(3)]


def test_only_new_files_are_taken(spark, parts, tmp_path, caplog):
    source, grown, whole = tmp_path / "in", str(tmp_path / "grown"), str(tmp_path / "whole")
    source.mkdir()
    shutil.copy(parts[0], source / "a.parquet")
    caplog.set_level(logging.INFO, "jobs")
    first = index_documents(spark, str(source), grown, f"{grown}/checkpoint")
    assert first == index.table(spark, grown, "documents").count() > 0
    assert index_documents(spark, str(source), grown, f"{grown}/checkpoint") == 0
    shutil.copy(parts[1], source / "b.parquet")
    shutil.copy(parts[2], source / "c.parquet")
    shutil.copy(parts[0], source / "again.parquet")  # delivered twice
    index_documents(spark, str(source), grown, f"{grown}/checkpoint", files_per_batch=1)
    assert len({r.batch for r in index.table(spark, grown, "documents").select("batch").distinct().collect()}) >= 3
    index_documents(spark, f"{DATA}/documents.parquet", whole, f"{whole}/checkpoint")
    assert everything(spark, grown) == everything(spark, whole)
    assert f"{first} new documents" in caplog.text and "0 documents added" in caplog.text
    # a lost checkpoint changes nothing either
    index_documents(spark, str(source), grown, f"{tmp_path}/another")
    assert everything(spark, grown) == everything(spark, whole)


def test_a_batch_that_failed_is_invisible_and_repeated(spark, parts, tmp_path):
    path = str(tmp_path / "index")
    one, two = (spark.read.parquet(p).select(F.col("doc_id").alias("id"), "text") for p in parts[:2])
    index.add(one, path, 0)
    before = everything(spark, path)
    index.add(two, path, 1)
    both = everything(spark, path)
    shutil.rmtree(f"{path}/statistics/batch=1")  # what a failure before the last write leaves
    assert everything(spark, path) == before
    index.add(two, path, 1)
    assert everything(spark, path) == both


def test_odd_documents(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = [(1, None), (2, ""), (3, "a b a"), (3, "a b a"), (4, "x"), (4, "y"), (None, "z"), (5, "word " * 50_000)]
    assert index.add(spark.createDataFrame(docs, "id long, text string"), path, 0) == 5
    found = {r.id: (r.length, {w.word: w.tf for w in r.tokens}) for r in index.table(spark, path, "documents").collect()}
    assert found.pop(4) in ((1, {"x": 1}), (1, {"y": 1}))
    assert found == {1: (0, {}), 2: (0, {}), 3: (3, {"a": 2, "b": 1}), 5: (50_000, {"word": 50_000})}
    assert index.add(spark.createDataFrame([], "id long, text string"), path, 1) == 0
    assert index.mean_length(spark, path) == pytest.approx(50_004 / 5)
    nothing = str(tmp_path / "nothing")
    assert index.table(spark, nothing, "documents").count() == index.statistics(spark, nothing).count() == 0 and index.mean_length(spark, nothing) == 1.0


def test_statistics_equal_an_index_built_anew(spark, tmp_path):
    docs = X.corpus(spark, DATA)
    index.add(docs.select(F.col("row_idx").alias("id"), F.col("dictation").alias("text")), str(tmp_path / "i"), 0)
    got = {r.token: (r.df, round(r.idf, 9)) for r in index.statistics(spark, str(tmp_path / "i")).collect()}
    assert got == {r.token: (r.df, round(r.idf, 9)) for r in retrieve.bm25_index(retrieve.corpus(docs, "row_idx")).collect()}


def test_runs_of_an_evaluation_stand_side_by_side(spark, tmp_path):
    source, target = f"{DATA}/conversations.parquet", str(tmp_path / "out")
    first = sorted(map(str, evaluation.evaluate(spark, source, target, "one").collect()))
    some = str(tmp_path / "some")
    spark.read.parquet(source).filter("conv_id % 2 = 0").write.parquet(some)
    other = evaluation.evaluate(spark, some, target, "two", folds=2)
    assert 0 < other.filter("level = 'case'").count() < evaluation.read(spark, target, "one").filter("level = 'case'").count()
    assert sorted(map(str, evaluation.read(spark, target, "one").collect())) == first
    assert {r.fold for r in other.filter("level = 'fold'").collect()} == {0, 1}
    none = str(tmp_path / "none")
    spark.read.parquet(source).filter("false").write.parquet(none)
    assert evaluation.evaluate(spark, none, target, "three").count() == 0
    plan = evaluation.summarised(spark.read.schema(evaluation.CASES).parquet(f"{target}/cases"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Expand" in plan


def test_command_lines(tmp_path):
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"run": "by-config", "target": str(tmp_path / "out")}))
    done = subprocess.run([sys.executable, "-m", "jobs.evaluate", "--config", str(config), "--conversations", f"{DATA}/conversations.parquet", "--folds", "3"], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "by-config:" in done.stderr and sorted(os.listdir(tmp_path / "out" / "cases" / "run=by-config"))[-3:] == ["fold=0", "fold=1", "fold=2"]
    assert subprocess.run([sys.executable, "-m", "jobs.index_documents", "--source", "x"], capture_output=True, timeout=100).returncode == 2
