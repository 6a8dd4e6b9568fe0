import csv
import json
import os
import shutil
import time
from types import SimpleNamespace

from editspark import __main__ as command
from editspark.__main__ import main
from editspark.plans import generate
from editspark.plans.prompts import SYSTEM_EXAMPLES
from editspark.sources import files
from editspark.sources.schemas import CASES
from editspark.streaming import shards

T = "FINDINGS:\nLUNGS: clear\nBONES: ok\nIMPRESSION:\nfine"


def write_csv(path, rows, extra=()):
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.DictWriter(f, [*CASES.names, *extra])
        w.writeheader()
        w.writerows(rows)


def a_case(k, **more):
    return {c: "" for c in CASES.names} | {"case_id": f"c{k}", "modality": "ct", "body_part": "b", "template_content": T.replace("\n", "\r\n"), "dictation": 'lungs "wet", all'} | more


def test_cases_keep_order_quotes_lines_and_have_no_nulls(spark, tmp_path):
    write_csv(tmp_path / "t.csv", [a_case(k) for k in range(30)])
    rows = files.read_cases(spark, str(tmp_path / "t.csv")).orderBy("row_idx").collect()
    assert [r.case_id for r in rows] == [f"c{k}" for k in range(30)]
    assert [r.row_idx for r in rows] == list(range(30))
    assert rows[0].template_content == T and rows[0].dictation == 'lungs "wet", all'
    assert rows[0].report == "" and rows[0].patient_sex == ""


def test_shards(spark, tmp_path):
    assert files.read_shard(spark, str(tmp_path / "none")).count() == 0
    lines = ['{"case_id": "a", "report": "1", "valid": true}', "", '{"case_id": "b", "report": "é"}', '{"report": "no id"}', '{"case_id": "a", "report": "2"}', '{"case_id": "c", "rep']
    (tmp_path / "s.jsonl").write_text("\n".join(lines), encoding="utf-8")
    got = {r.case_id: (r.report, r.valid) for r in files.last_records(files.read_shard(spark, str(tmp_path / "s.jsonl"))).collect()}
    assert got == {"a": ("2", None), "b": ("é", None)}


def test_later_appends_win_and_lines_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "shard")
    for k in range(5):
        files.append_shard(spark.createDataFrame([("a", f"r{k}", True), (f"b{k}", "x", True)], "case_id string, report string, valid boolean").coalesce(1), path)
    got = {r.case_id: r.report for r in files.last_records(files.read_shard(spark, path)).collect()}
    assert got["a"] == "r4" and len(got) == 6
    # a copy whose files come in another order of time, and a compacted one, read the same
    copied = tmp_path / "copied"
    for k in (3, 1, 5, 4, 2):
        shutil.copytree(f"{path}/sequence={k:012d}", copied / f"sequence={k:012d}", copy_function=shutil.copyfile)
        time.sleep(0.02)
    assert {r.case_id: r.report for r in files.last_records(files.read_shard(spark, str(copied))).collect()} == got
    files.compact_shard(spark, path, str(tmp_path / "compacted"))
    rows = files.read_shard(spark, str(tmp_path / "compacted")).orderBy("ordinal").collect()
    assert [r.case_id for r in rows] == ["a", *(f"b{k}" for k in range(5))] and {r.case_id: r.report for r in rows} == got
    assert len([f for f in os.listdir(tmp_path / "compacted" / f"sequence={1:012d}") if f.startswith("part")]) == 1
    assert files.append_shard(spark.createDataFrame([("a", "later", True)], "case_id string, report string, valid boolean"), str(tmp_path / "compacted")) == 2
    assert {r.case_id: r.report for r in files.last_records(files.read_shard(spark, str(tmp_path / "compacted"))).collect()} == got | {"a": "later"}
    (tmp_path / "long.jsonl").write_text("\n".join(json.dumps({"case_id": "c", "report": f"{k:05}" + "y" * 2000}) for k in range(2_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        rows = files.read_shard(spark, str(tmp_path / "long.jsonl"))
        assert rows.rdd.getNumPartitions() > 4
        assert files.last_records(rows).first().report[:5] == "01999" and [r.report[:5] for r in rows.orderBy("ordinal").collect()] == [f"{k:05}" for k in range(2_000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_submissions_in_parts_follow_each_other(spark, tmp_path):
    rows = spark.range(3_000).selectExpr("id AS row_idx", "'c' || id AS case_id", "repeat('x', 50) AS report").repartition(7)
    files.write_submission(rows, str(tmp_path / "parts"))
    names = sorted((tmp_path / "parts").glob("part-*"))
    assert [x for n in names for x in (r["case_id"] for r in csv.DictReader(open(n)))] == [f"c{k}" for k in range(3_000)]


def test_commands(spark, tmp_path, capsys):
    write_csv(tmp_path / "train.csv", [a_case(k, report=T.replace("clear", "wet")) for k in range(5)], ["report"])
    write_csv(tmp_path / "test.csv", [a_case(k) for k in range(5)])
    answers = [{"case_id": f"c{k}", "raw_response": json.dumps({"field_updates": {"LUNGS": "wet"}, "impression": ""}) if k != 3 else "broken"} for k in range(5)]
    (tmp_path / "answers.jsonl").write_text("\n".join(map(json.dumps, answers)))
    common = ["--train", str(tmp_path / "train.csv"), "--test", str(tmp_path / "test.csv"), "--shard"]
    runs = ["--responses", str(tmp_path / "answers.jsonl")]
    assert main(["cv", *common, str(tmp_path / "cv"), *runs, "--start", "0", "--count", "3"]) == 0
    assert main(["cv", *common, str(tmp_path / "cv"), *runs, "--start", "0", "--count", "9"]) == 2
    assert main(["score", *common, str(tmp_path / "cv"), "--output", str(tmp_path / "summary")]) == 0
    summary = json.loads(next((tmp_path / "summary").glob("part-*")).read_text())
    assert summary["cases_scored"] == 4 and summary["overall_res"] == 0 and summary["train_total"] == 5
    assert main(["test", *common, str(tmp_path / "test"), *runs]) == 2
    assert main(["merge", *common, str(tmp_path / "test"), "--output", str(tmp_path / "out"), "--allow-partial"]) == 0
    with open(next((tmp_path / "out").glob("part-*")), newline="", encoding="utf-8") as f:
        rows = list(csv.DictReader(f))
    assert [r["case_id"] for r in rows] == [f"c{k}" for k in range(5)]
    assert rows[3]["report"] == T and "LUNGS: wet" in rows[2]["report"]
    assert main(["status", *common, str(tmp_path / "test")]) == 0


CALLS: list = []
ANSWERS: dict = {}


def provider(request):
    """Answers by what a prompt's target says; ``ANSWERS`` may make it fail."""
    CALLS.append(request)
    if request.prompt == "Reply with: OK":
        return "OK"
    case = request.prompt.split("Dictation:\n")[-1].split("\n")[0]
    return ANSWERS.get(case, json.dumps({"field_updates": {"LUNGS": "wet"}, "impression": ""}))


def test_slices_save_as_they_go_and_stop_at_an_exhausted_quota(spark, tmp_path, monkeypatch):
    waits = []
    paced = SimpleNamespace(sleep=waits.append, monotonic=time.monotonic)  # for these two modules only: other threads' sleeps must stay
    for module in (generate, command):
        monkeypatch.setattr(module, "time", paced)
    write_csv(tmp_path / "train.csv", [{**a_case(k, report=T.replace("clear", "wet")), "dictation": f"wet lungs {k}"} for k in range(5)], ["report"])
    write_csv(tmp_path / "test.csv", [{**a_case(k), "dictation": f"wet lungs {k}"} for k in range(5)])
    common = ["test", "--train", str(tmp_path / "train.csv"), "--test", str(tmp_path / "test.csv"), "--shard", str(tmp_path / "shard"), "--provider", f"{__name__}:provider"]
    common += ["--sleep", "0.25", "--wait", "7", "--api-key", "k", "--model", "m"]
    CALLS.clear()
    ANSWERS.clear()
    ANSWERS.update({"wet lungs 1": "not json", "wet lungs 3": ""})
    assert main(common) == 2  # the fourth case gets no answer
    assert {r.case_id for r in files.read_shard(spark, str(tmp_path / "shard")).collect()} == {"c0", "c2"}
    assert [w for w in waits if w == 0.25] == [0.25] * 3 and [w for w in waits if w in (7, 14, 21)] == [7, 14, 21]
    asked = CALLS[1]
    assert (asked.model, asked.key, asked.temperature, asked.response_type) == ("m", "k", 0.1, "application/json") and asked.system == SYSTEM_EXAMPLES
    ANSWERS.clear()
    assert main(common) == 0
    assert sorted(r.case_id for r in files.read_shard(spark, str(tmp_path / "shard")).collect()) == [f"c{k}" for k in range(5)]
    assert main(common) == 0 and main([*common, "--start", "99"]) == 0


def test_one_command_for_all(spark, tmp_path, capsys):
    write_csv(tmp_path / "train.csv", [a_case(k, report=T.replace("clear", "wet")) for k in range(6)], ["report"])
    write_csv(tmp_path / "test.csv", [a_case(k) for k in range(3)])
    assert main(["run", "--train", str(tmp_path / "train.csv"), "--test", str(tmp_path / "test.csv"), "--output", str(tmp_path / "out"), "--summary", str(tmp_path / "summary"), "--max-cases", "4"]) == 0
    assert json.loads(next((tmp_path / "summary").glob("part-*")).read_text())["total_cases"] == 4
    with open(next((tmp_path / "out").glob("part-*")), newline="", encoding="utf-8") as f:
        assert [r["case_id"] for r in csv.DictReader(f)] == ["c0", "c1", "c2"]


def test_streamed_shards_keep_the_last_record(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.jsonl").write_text('{"case_id": "a", "res": 1, "modality": "x"}\n{"case_id": "b", "res": 2}\nbroken')

    def run():
        shards.ingest(shards.stream_shard(spark, str(folder)), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
        return {r.case_id: r.res for r in shards.current(spark, str(tmp_path / "state")).collect()}

    assert run() == {"a": 1, "b": 2}
    (folder / "2.jsonl").write_text('{"case_id": "a", "res": 3}')
    assert run() == {"a": 3, "b": 2}
    q = shards.summary(shards.stream_shard(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("by_modality").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.modality, r.n) for r in spark.table("by_modality").collect()} == {("x", 1), ("?", 2)}
