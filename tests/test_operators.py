import json
import math
import random
import statistics
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from editspark.operators import batch, evaluate, nearest, retrieve, sketch
from editspark.plans import crossval, fixtures, generate, prompts
from editspark.sources import files, scratch

CASES = "case_id string, row_idx long, modality string, body_part string, template_content string, dictation string, report string, predicted string"


def test_scores(spark):
    t = "FINDINGS:\nA: ok\nB: ok\nIMPRESSION:\nfine"
    rows = [
        ("same", 0, "m", "b", t, "", t, t),
        ("none", 1, "m", "b", "", "", "", ""),
        ("extra", 2, "m", "b", t, "", t, "FINDINGS:\nA: ok\nB: ok\nC: new\nIMPRESSION:\nfine"),
        ("missing", 3, "m", "b", t, "", "FINDINGS:\nA: node\nB: ok\nIMPRESSION:\nfine", "FINDINGS:\nB: ok\nIMPRESSION:\nbad"),
        ("untemplated", 4, "m", "b", t, "", "FINDINGS:\nD: node\nIMPRESSION:\nfine", "FINDINGS:\nD: node mass\nIMPRESSION:\nfine"),
    ]
    got = {r.case_id: r for r in evaluate.report_scores(spark.createDataFrame(rows, CASES)).collect()}
    assert got["same"].res_case == got["none"].res_case == 0
    assert got["extra"].findings_score == pytest.approx(2 / 4)
    assert got["missing"].findings_score == pytest.approx(3 / 4)
    assert got["missing"].res_case == pytest.approx(0.65 * 0.75 + 0.35)
    assert got["untemplated"].findings_score == pytest.approx(0.5)


def test_folds_are_round_robin_in_row_order_and_whole_under_a_hot_stratum(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "RUN", 7)
    rows = [(k, "a_b" if k % 3 else "a", "c" if k % 3 else "b_c") for k in range(40)]
    got = evaluate.stratified_folds(spark.createDataFrame(rows, "row_idx long, modality string, body_part string")).collect()
    assert {r.row_idx: r.fold for r in got} == {k: k % 5 for k in range(40)}  # both pairs join to one key


def test_empty_folds_and_summaries(spark):
    none = spark.createDataFrame([], "case_id string, res double, valid boolean, modality string, ordinal long")
    assert evaluate.score_summary(none).count() == 0
    assert files.last_records(none).count() == 0


@pytest.mark.parametrize("values", [[], [None], [3.5], [1.0, 2.0], [2.0] * 7, [5.0, -1.0, None, 5.0, 0.25], [k**3 / 7 for k in range(101)], [k % 3 * 1.0 for k in range(100)]])
def test_median(spark, values):
    got = evaluate.median(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()
    known = [v for v in values if v is not None]
    assert [r.median for r in got] == ([statistics.median(known)] if known else [])


def words(text):
    return text.lower().split()


def brute_force(queries, docs, k, loo):
    """Retrieval by scoring every pair: all texts plain lower-case words, so one tokenizer serves."""
    n = len(docs)
    bags = [Counter(words(d["dictation"])) for d in docs]
    df = Counter(w for b in bags for w in b)
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    size = [sum(b.values()) for b in bags]

    def terms(c):
        w = words(f"{c['study_description']} {c['dictation']}")
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])

    tb = [terms(d) for d in docs]
    tdf = Counter(w for b in tb for w in b)

    def unit(b):
        v = {w: c * (math.log((1 + n) / (1 + tdf[w])) + 1) for w, c in b.items() if w in tdf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / norm for w, x in v.items()}

    tv = [unit(b) for b in tb]
    out = {}
    for q in queries:
        raw = [sum(idf.get(w, 0) * b[w] * 2.5 / (b[w] + 1.5 * (0.25 + 0.75 * s / (sum(size) / n))) for w in words(q["dictation"])) for b, s in zip(bags, size, strict=True)]
        most = max(raw) if max(raw) > 0 else 1
        qv = unit(terms(q))
        scores = []
        for d, r, v in zip(docs, raw, tv, strict=True):
            if loo and d["case_id"] == q["case_id"]:
                continue
            mine, theirs = ({*headers(int(x["case_id"][1:]))} for x in (q, d))
            s = 0.4 * len(mine & theirs) / len(mine | theirs) if mine and theirs else 0
            s += 0.35 * r / most + 0.25 * sum(x * v.get(w, 0) for w, x in qv.items())
            s *= (1.2 if d["modality"] == q["modality"] else 0.8) * (1.3 if d["body_part"] == q["body_part"] else 0.7)
            if s > 0:
                scores.append((-round(s, 9), -d["row_idx"]))
        out[q["row_idx"]] = [-i for _, i in sorted(scores)[:k]]
    return out


def headers(k):
    return [h for j, h in enumerate(("LUNGS", "HEART", "BONES", "OTHER FINDINGS")) if (k >> j) & 1]


def corpus(n):
    vocabulary = ["node", "mass", "clear", "lung", "liver", "rib", "left", "wide", "dense", "old"]
    return [
        {"case_id": f"c{k}", "row_idx": k, "modality": "ct" if k % 2 else "mr", "body_part": "ab"[k % 3 // 2], "study_description": "scan " + vocabulary[k % 7],
         "template_content": "FINDINGS:\n" + "".join(f"{h}: x\n" for h in headers(k)) + "\nIMPRESSION:\nx", "dictation": " ".join(vocabulary[(k * j + j) % 10] for j in range(1, 2 + k % 6))}
        for k in range(n)
    ]


@pytest.mark.parametrize("loo", [False, True])
def test_retrieval_equals_scoring_every_pair(spark, loo):
    docs = corpus(23)
    df = spark.createDataFrame(docs)
    q = retrieve.prepared(df, "row_idx")
    got: dict = {}
    for r in retrieve.top_k(retrieve.hybrid_scores(q, q, exclude_self=loo), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == brute_force(docs, docs, 4, loo)


@pytest.mark.parametrize("loo, words, together, dense, columns, products", [(False, 200, 5, 0, 3, 7), (True, 1_000_000, 9, 2, 2048, 5)])
def test_best_in_blocks_and_chunks_writes_no_pairs(spark, monkeypatch, loo, words, together, dense, columns, products):
    """Equal to scoring every pair whatever the sizes of blocks and whichever way words are multiplied; no table that is written has a row a pair."""
    docs, sizes = corpus(23), {}

    def seen(df, name):
        out = scratch.written(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    p = retrieve.corpus(spark.createDataFrame(docs), "row_idx")
    expected = brute_force(docs, docs, 2, loo)
    for name, value in {"WORDS": words, "TOGETHER": together, "DENSE": dense, "COLUMNS": columns, "PRODUCTS": products}.items():
        monkeypatch.setattr(nearest, name, value)
    monkeypatch.setattr(retrieve, "written", seen)
    got: dict = {}
    for r in retrieve.best(p, p, 2, exclude_self=loo).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == expected
    assert max(n for name, n in sizes.items() if name not in ("asked", "index")) <= 2 * len(docs)
    if loo:
        assert retrieve.best(p, p.limit(0)).count() == retrieve.best(p.limit(0), p).count() == 0


def test_best_without_a_case_reads_documents_once_a_chunk(spark, monkeypatch):
    """Where each case's own document has its greatest BM25 score, no pass of its own looks for that."""
    docs = [{**d, "dictation": " ".join((f"{d['dictation']} own{'abcdefghijklmnopqrstuvw'[d['row_idx']]}".split() * 20)[:20])} for d in corpus(23)]
    p = retrieve.corpus(spark.createDataFrame(docs), "row_idx")
    passes = []
    monkeypatch.setattr(retrieve, "greatest", lambda chunk, *more: passes.append(len(chunk.ids)) or nearest.greatest(chunk, *more))
    got: dict = {}
    for r in retrieve.best(p, p, 2, exclude_self=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == brute_force(docs, docs, 2, True)
    assert sum(passes) < len(docs) // 2


def test_best_of_blocks_that_are_only_about_right():
    """Scores in single precision choose what is scored exactly: equal to sorting all exact scores, ties by row, whatever the blocks."""
    rng = np.random.default_rng(3)
    n, k = 1_000, 3
    left, right = rng.random((7, 40)), rng.random((n, 40)).round(2)
    right[::5] = right[3]  # copies: ties of many rows
    left[6] = 0  # nothing above 0
    found = nearest.Best(7, k, 9)
    row_idx = rng.permutation(n)
    for at in range(0, n, 300):
        dense = nearest.Dense((7, len(right[at : at + 300])))
        dense.add([(left, right[at : at + 300])])
        others = np.zeros(dense.about.shape)
        assert (np.abs(dense.about - left @ right[at : at + 300].T) <= dense.off[:, None]).all()
        found.add(slice(0, 7), dense.with_others(others), dense.off, dense.at, row_idx[at : at + 300], at)
    score = np.einsum("ij,kj->ik", left, right).round(9)
    for q in range(6):
        assert found.document[q].tolist() == np.lexsort((-row_idx, -score[q]))[:k].tolist()
    assert (found.rounded[6] < 0).all()


def test_a_chunk_that_several_tasks_of_a_process_use_is_made_ready_once():
    words = pa.array([[{"word": 1, "value": 2.0}, {"word": 5, "value": 1.0}], [{"word": 5, "value": 3.0}]])
    table = pa.table({"id": [0, 1], "case_id": ["a", "b"], "modality": ["x", "x"], "body_part": ["y", "y"], "headers": [[7], [8]], "tokens": words, "terms": words, "own": [1.0, 2.0]})
    chunk = nearest.Chunk(table)
    once = chunk.ready(np.array([2.0, 4.0])).tokens.value.tolist()
    assert chunk.ready(np.array([2.0, 4.0])).tokens.value.tolist() == once


@pytest.mark.parametrize("cells, asked", [(64, 4_000_000), (0, 150)])
def test_best_of_texts_writes_no_table_of_their_words(spark, monkeypatch, cells, asked):
    """Equal to scoring every pair, also where cells hold many terms, bounds are looked at one by one and few terms are counted at a time; only words that are asked for are written of a text."""
    docs, queries, held = corpus(23), corpus(23)[4:9], {}
    docs = [{**d, "dictation": d["dictation"] + " never asked for " + " ".join(f"w{a}{b}" for a in "abcdef" for b in "ghijk")} for d in docs]

    def seen(df, name):
        out = scratch.written(df, name)
        if name == "digest":
            held["words"] = [x for r in out.filter("row_idx is not null").collect() for x in (*r.tokens, *r.terms)]
        return out

    for name, value in {"CELLS": cells, "ASKED": asked, "FIRST": 3, "GROWTH": 2}.items():
        monkeypatch.setattr(sketch, name, value)
    monkeypatch.setattr(sketch, "written", seen)
    got: dict = {}
    for r in sketch.best_of_texts(spark.createDataFrame(queries), spark.createDataFrame(docs), "row_idx", 2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == brute_force(queries, docs, 2, False)
    assert len(held["words"]) < 30 * len(docs)  # of 70 and more


def test_counts_in_a_byte_are_never_too_small():
    counts = np.unique(np.concatenate([np.arange(5_000), 1.5 ** np.arange(44)]).astype(np.int64))
    assert (sketch.decoded(sketch.coded(counts)) >= counts).all() and sketch.decoded(sketch.coded(np.array([0])))[0] == 0
    assert (sketch.decoded(sketch.coded(counts)) <= counts * sketch.STEP * 1.001 + 1).all()


def test_retrieval_edges(spark):
    docs = spark.createDataFrame(corpus(5))
    empty = spark.createDataFrame([("x", 0, "", "")], "case_id string, row_idx long, dictation string, study_description string")
    p = retrieve.prepared(docs, "row_idx")
    assert retrieve.top_k(retrieve.hybrid_scores(retrieve.prepared(empty, "row_idx"), p)).count() == 0
    assert retrieve.top_k(retrieve.hybrid_scores(p, p), 0).count() == 0
    none = retrieve.prepared(docs.limit(0), "row_idx")
    assert retrieve.top_k(retrieve.hybrid_scores(p, none)).count() == 0


def test_retrieval_never_pairs_all(spark):
    p = retrieve.prepared(spark.createDataFrame(corpus(9)), "row_idx")
    plan = retrieve.top_k(retrieve.hybrid_scores(p, p, exclude_self=True))._jdf.queryExecution().toString()
    physical = plan[plan.index("Physical Plan") :]
    assert "CartesianProduct" not in physical
    assert "WindowGroupLimit" in physical


def test_prompt_text(spark):
    """Byte for byte, with two examples and with none."""
    t = "FINDINGS:\nLUNGS: clear\nHEART: fine\n\nIMPRESSION:\nnormal"
    query = ("q", 0, "CT", "CHEST", "CT chest", t, "lungs wet", "")
    past = [("a", 1, "CT", "CHEST", "CT chest", t, "lungs dense é", t.replace("clear", "dense “é”").replace("normal", "bad")), ("b", 2, "MR", "HEAD", "MR head", t, "nothing", t)]
    spec = "case_id string, row_idx long, modality string, body_part string, study_description string, template_content string, dictation string, report string"
    cases, other = spark.createDataFrame([query], spec), spark.createDataFrame(past, spec)
    retrieved = other.orderBy("row_idx").agg(F.array_sort(F.collect_list(F.struct("row_idx", F.struct(*other.columns).alias("c")))).alias("r")).select(F.lit("q").alias("query_id"), F.transform("r", lambda x: x.c).alias("examples"))
    shown = (
        "--- EXAMPLE 1 ---\nModality: CT | Body Part: CHEST\nTemplate:\n" + t + "\n\nDictation:\nlungs dense é\n\nExpected Report Updates (JSON):\n"
        '{\n  "field_updates": {\n    "LUNGS": "dense \\u201c\\u00e9\\u201d"\n  },\n  "impression": "bad"\n}\n\n'
        "--- EXAMPLE 2 ---\nModality: MR | Body Part: HEAD\nTemplate:\n" + t + "\n\nDictation:\nnothing\n\nExpected Report Updates (JSON):\n"
        '{\n  "field_updates": {},\n  "impression": "normal"\n}\n\n'
    )
    head = "Below are examples showing how past dictations were incorporated into templates:\n\n"
    target = "=== TARGET CASE TO PROCESS ===\nModality: CT | Body Part: CHEST\nStudy Description: CT chest\nTemplate:\n" + t + "\n\nDictation:\nlungs wet\n\nGenerate the target case field_updates and impression strictly in valid JSON format:"
    assert prompts.build_prompts(cases, retrieved).first().prompt == head + shown + target
    assert prompts.build_prompts(cases, retrieved.limit(0)).first().prompt == head + target


def test_decoding(spark):
    raws = {
        '{"field_updates": {"A, <b>: C": "x", "N": null}, "impression": "i"}': (True, [("A, <b>: C", "x"), ("N", "")], "i"),
        '{"impression": null}': (True, [], ""),
        '{"field_updates": {}}': (True, [], ""),
        '{"field_updates": null}': (False, [], ""),
        '{"field_updates": {"A": 3}}': (False, [], ""),
        '{"field_updates": {"A": "x"}, "impression": 5}': (False, [], ""),
        "[1]": (False, [], ""),
        '{"field_updates"': (False, [], ""),
        "": (False, [], ""),
    }
    rows = spark.createDataFrame([(r,) for r in raws], "raw string").select("raw", generate.decode(F.col("raw")).alias("d")).collect()
    assert {r.raw: (r.d.ok, sorted((u.key, u.value) for u in r.d.updates), r.d.impression) for r in rows} == raws


def test_fallback_and_strict(spark):
    t = "FINDINGS:\nLUNGS: clear\nIMPRESSION:\nfine"
    cases = spark.createDataFrame([("a", t, "lungs wet"), ("b", t, "lungs wet"), ("c", t, "lungs wet")], "case_id string, template_content string, dictation string")
    answers = spark.createDataFrame([("a", json.dumps({"field_updates": {"lungs": "dense"}, "impression": "bad"})), ("b", "oops")], "case_id string, raw_response string")
    loose = {r.case_id: (r.source, r.report.split("\n")[1]) for r in generate.reports(cases, answers).collect()}
    assert loose == {"a": ("model", "LUNGS: dense"), "b": ("rules", "LUNGS: Lungs wet"), "c": ("rules", "LUNGS: Lungs wet")}
    strict = {r.case_id: (r.status, r.report is None) for r in generate.reports(cases, answers, strict=True).collect()}
    assert strict == {"a": ("ok", False), "b": ("undecodable", True), "c": ("no response", True)}


def test_provider_retries_only_what_may_be_retried(spark):
    prompts = spark.createDataFrame([("ok", "fine"), ("bad", "broken"), ("empty", "silent")], "case_id string, prompt string")

    def provider(request):
        if request.prompt == "broken":
            raise ValueError("no such model")
        return {"fine": request.system[:3] + request.model + request.key, "silent": ""}[request.prompt]

    settings = generate.Settings().overridden("k", "m")
    got = {r.case_id: r.raw_response for r in generate.call_provider(prompts, provider, settings, tries=2, wait_s=0).collect()}
    assert got == {"ok": "Youmk", "bad": "", "empty": ""}
    with pytest.raises(generate.QuotaExhausted):
        generate.preflight(lambda p: "")


def test_rates_and_quotas(monkeypatch):
    waits, calls = [], []
    monkeypatch.setattr(generate.time, "sleep", waits.append)

    def refused(request):
        calls.append(request)
        if len(calls) < 3:
            raise RuntimeError("429 RESOURCE_EXHAUSTED")
        return "{}"

    assert generate.ask(refused, generate.Request("p"), wait_s=5) == "{}" and waits == [5, 10]
    waits.clear()
    with pytest.raises(generate.QuotaExhausted, match="4 attempts"):
        generate.insist(lambda r: "", generate.Request("p"), wait_s=10)
    assert waits == [10, 20, 30]
    assert "secret" not in repr(generate.Request("p", key="secret"))


def test_settings(monkeypatch):
    monkeypatch.setenv("GOOGLE_API_KEY", " env ")
    monkeypatch.delenv("GEMINI_API_KEY", raising=False)
    assert generate.Settings().key() == "env" and generate.Settings().overridden(" own ", "m").key() == "own"
    assert generate.Settings().overridden().model == generate.Settings().model


def test_batches(spark):
    cases = spark.createDataFrame([(f"c{k}", k, f"t{k}") for k in range(6)], "case_id string, row_idx long, template_content string")
    done = spark.createDataFrame([("c1", "r1", True), ("c4", None, False), ("gone", "x", None)], "case_id string, report string, valid boolean")
    assert [r.case_id for r in batch.slice_window(cases, 4, 10).orderBy("row_idx").collect()] == ["c4", "c5"]
    assert batch.slice_window(cases, 9, 3).count() == 0
    status = batch.batch_status(cases, done).first()
    assert (status.n_done, status.n_total, status.pct, status.next_start) == (3, 6, 50.0, 0)
    merged = {r.case_id: (r.report, r.is_placeholder) for r in batch.merge(cases, done).collect()}
    assert merged["c1"] == ("r1", False) and merged["c4"] == (None, False) and merged["c5"] == ("t5", True)
    counts = batch.merge_counts(cases, done).first()
    assert (counts.n_rows, counts.n_generated, counts.n_placeholder, counts.n_invalid) == (6, 2, 4, 1)
    with pytest.raises(ValueError, match="c0"):
        batch.require_complete(cases, done)
    batch.require_complete(cases, done, allow_partial=True)


def test_cross_validation_with_and_without_answers(spark):
    t, truth = "FINDINGS:\nLUNGS: clear\nIMPRESSION:\nfine", "FINDINGS:\nLUNGS: Lungs wet\nIMPRESSION:\nlungs wet"
    rows = [(f"c{k}", k, "m", "b", t, "lungs wet", truth, "") for k in range(7)]
    cases = spark.createDataFrame(rows, CASES)
    by_rules = {r.case_id: (r.res_case, r.valid, r.fold) for r in crossval.cross_validated(cases).collect()}
    assert by_rules == {f"c{k}": (0.0, True, k % 5) for k in range(7)}
    answers = spark.createDataFrame([("c0", json.dumps({"field_updates": {"LUNGS": "dry"}, "impression": "lungs wet"}))], "case_id string, raw_response string")
    got = {r.case_id: r.res_case for r in crossval.cross_validated(cases, answers).collect()}
    assert got["c0"] > 0 and got["c1"] == 0
    means = {r.fold: r.n for r in evaluate.fold_means(crossval.cross_validated(cases)).collect()}
    assert means == {0: 2, 1: 2, 2: 1, 3: 1, 4: 1}
    assert evaluate.overall(crossval.cross_validated(cases)).first().total_cases == 7


@pytest.mark.parametrize("seed", range(3))
def test_median_by_ranges_of_values_that_occur(spark, monkeypatch, seed):
    """One outlier, a value that half the rows have, and more distinct values than one task may rank."""
    monkeypatch.setattr(evaluate, "FEW", 40)
    monkeypatch.setattr(evaluate, "SPLITS", 8)
    asked = []
    monkeypatch.setattr(evaluate, "written", lambda df, name: asked.append(scratch.written(df, name)) or asked[-1])
    draw = random.Random(seed)
    values = [1e18, -1e18] + [draw.random() for _ in range(3001 + seed)] + [0.25] * draw.choice([0, 1500, 4000])
    got = evaluate.median(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()
    assert [r.median for r in got] == [statistics.median(values)]
    sizes = [df.count() for df in asked]
    assert len(sizes) >= 3 and sizes[-1] <= 40 and all(b <= a / 3 for a, b in zip(sizes, sizes[1:]))


def test_scoring_reads_cases_once(spark, tmp_path):
    fixtures.cases(spark, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/cases")
    scores = evaluate.report_scores(spark.read.parquet(f"{tmp_path}/cases"), "modality")
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    by_fields = evaluate.findings_scores(evaluate.scored_fields(evaluate.parsed(spark.read.parquet(f"{tmp_path}/cases"))))
    expected = {r.case_id: r.findings_score for r in by_fields.collect()}
    assert {r.case_id: r.findings_score for r in scores.collect()} == pytest.approx(expected)


def test_corpus_makes_the_words_that_are_asked_for(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "written", lambda df, name: df)
    plans = {c: retrieve.corpus(fixtures.corpus(spark, "/root/testdata/sf0.001"), "row_idx", c)._jdf.queryExecution().executedPlan().toString() for c in ("tokens", "terms")}
    assert "_counted_terms" not in plans["tokens"] and "_counted_tokens" not in plans["terms"] and "_counted_terms" in plans["terms"]


def test_scoring_sends_no_tokens_and_folds_read_written_scores(spark, tmp_path):
    fixtures.cases(spark, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/cases")
    cases = spark.read.parquet(f"{tmp_path}/cases")
    plan = evaluate.report_scores(cases)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    folds = crossval.cross_validated(cases)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in folds and f"{tmp_path}/cases" not in folds


def test_scoring_of_reports_without_fields(spark):
    rows = [("a", "x", "FINDINGS:\n\nIMPRESSION:\nclear", "FINDINGS:\n\nIMPRESSION:\nclear", ""), ("b", None, "", "", ""), ("c", "x", "IMPRESSION:\nmass", "", None), ("c2", "x", "", "A: b", "")]
    df = spark.createDataFrame(rows, "case_id string, modality string, report string, predicted string, template_content string")
    got = {r.case_id: (r.modality, round(r.findings_score, 6), round(r.impression_score, 6)) for r in evaluate.report_scores(df, "modality").collect()}
    assert got == {"a": ("x", 0.0, 0.0), "b": (None, 0.0, 0.0), "c": ("x", 1.0, 0.0), "c2": ("x", 1.0, 0.0)}


def test_calls_of_all_tasks_share_one_pace(spark, tmp_path):
    log, spacing = str(tmp_path / "calls"), 0.08

    def provider(request):
        with open(log, "a") as f:
            f.write(f"{time.time()}\n")
        if request.prompt == "again" and sum(1 for _ in open(log)) < 12:
            raise RuntimeError("429")
        return "{}"

    prompts = spark.createDataFrame([(str(k), "again" if k == 3 else "p") for k in range(24)], "case_id string, prompt string").repartition(6)
    for tasks in (1, 4):
        got = generate.call_provider(prompts, provider, generate.Settings(), spacing_s=spacing, tasks=tasks, tries=5, wait_s=0).collect()
        assert len(got) == 24 and {r.raw_response for r in got} <= {"{}", ""}
    at = sorted(float(x) for x in open(log))
    assert len(at) >= 48 and min(b - a for a, b in zip(at, at[1:])) > 0.4 * spacing
    for start in at:  # never more calls in a second than its slots, and one that a late start may add
        assert sum(start <= t < start + 1 for t in at) <= 1 / spacing + 2


def test_lengths_of_hashed_terms_are_those_of_terms(spark, monkeypatch):
    """With terms of every kind: broadcast, of several documents but not broadcast, of one document."""
    docs = spark.createDataFrame(corpus(23))
    found = {}
    for hashed in (False, True):
        for frequent in (0, 5, 250_000):
            monkeypatch.setattr(retrieve, "FREQUENT", frequent)
            p = retrieve.corpus(docs, "row_idx", hashed=hashed)
            rows = retrieve.lengths(p, retrieve.tfidf_index(p)).collect()
            found[hashed, frequent] = {r.id: round(r.norm, 9) for r in rows}
    assert len(found[False, 0]) and all(x == found[False, 0] for x in found.values())
