from pyspark.sql import functions as F

from editspark.functions import report as R

PARSED = {
    "FINDINGS:\nLUNGS: clear\nBONES: ok\n\nIMPRESSION:\nFine.": ([("LUNGS", "clear"), ("BONES", "ok")], "Fine."),
    "LUNGS: clear": ([("LUNGS", "clear")], ""),
    "Intro\nFINDINGS:\nLUNGS: clear": ([("FINDINGS", ""), ("LUNGS", "clear")], ""),
    "FINDINGS:\nT2\nBONES: ok": ([("T2\nBONES", "ok")], ""),
    "FINDINGS:\nLIVER:\nSPLEEN: x": ([("LIVER", ""), ("SPLEEN", "x")], ""),
    "FINDINGS:\nA: 1\nIMPRESSION: one\nIMPRESSION: two": ([("A", "1")], "one"),
    "FINDINGS:\nA: 1\nA: 2": ([("A", "1"), ("A", "2")], ""),
    "FINDINGS:\nlungs: clear\nA: 1\nB & C: 2": ([("A", "1\nB & C: 2")], ""),
    "IMPRESSION: alone": ([("IMPRESSION", "alone")], ""),
    "FINDINGS:\nIMPRESSION:": ([], ""),
    "findings: \n L1-L2 (A/B): wide\nimpression: Low": ([("L1-L2 (A/B)", "wide")], "Low"),
    "": ([], ""),
}


def parsed(spark, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r for r in rows.select("k", R.parse(F.col("t")).alias("p")).orderBy("k").collect()]


def test_parse_goldens(spark):
    for row, (text, expected) in zip(parsed(spark, PARSED), PARSED.items(), strict=True):
        assert ([(f.key, f.value) for f in row.p.fields], row.p.impression) == expected, text


def test_parse_finds_sections_and_values_once(spark):
    df = spark.createDataFrame([("FINDINGS:\nA:\u00a0x \u2028\nB:\n\nIMPRESSION:\x1f y\x85",)], "t string").select(R.parse(F.col("t")).alias("p"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2
    p = df.first().p
    assert ([(f.key, f.value) for f in p.fields], p.impression) == ([("A", "x"), ("B", "")], "y")


def test_parse_null(spark):
    assert parsed(spark, [None])[0].p.fields == []


TEMPLATE = "FINDINGS:\nLUNGS: clear\nBONES: ok\nIMPRESSION:\nNormal."


def rendered(spark, updates, impression, template=TEMPLATE):
    rows = spark.createDataFrame([(template, updates, impression)], "t string, u array<struct<key:string,value:string>>, i string")
    return rows.select(R.render(R.parse(F.col("t")), F.col("u"), F.col("i")).alias("r")).first().r


def test_render(spark):
    assert rendered(spark, [("lungs ", " dense "), ("bones", ""), ("node", "big"), ("empty", "")], " ") == "FINDINGS:\nLUNGS: dense\nBONES: ok\nNODE: big\n\nIMPRESSION:\nNormal."
    assert rendered(spark, [("LUNGS", "one"), ("lungs", "two")], "New") == "FINDINGS:\nLUNGS: one\nBONES: ok\n\nIMPRESSION:\nNew"
    assert rendered(spark, [], None, "") == "FINDINGS:\n\n\nIMPRESSION:\n"
    assert rendered(spark, [], "x", "FINDINGS:\nA: 1\nA: 2\nIMPRESSION:\ny") == "FINDINGS:\nA: 1\nA: 2\n\nIMPRESSION:\nx"


def test_differences_applied_give_the_report_back(spark):
    report = "FINDINGS:\nLUNGS: dense\nBONES: ok\n\nIMPRESSION:\nPneumonia."
    rows = spark.createDataFrame([(TEMPLATE, report)], "t string, r string").select(R.parse(F.col("t")).alias("t"), R.parse(F.col("r")).alias("r"))
    out = rows.select(R.changed_fields(F.col("t"), F.col("r")).alias("u"), "t", "r").select("u", R.render(F.col("t"), F.col("u"), F.col("r.impression")).alias("again")).first()
    assert [(u.key, u.value) for u in out.u] == [("LUNGS", "dense")]
    assert out.again == report


def test_repeated_changed_keys_merge_as_in_a_dictionary(spark):
    rows = spark.createDataFrame([("FINDINGS:\nA: 0", "FINDINGS:\nA: 1\nB: 2\nA: 0\nA: 3")], "t string, r string")
    got = rows.select(R.changed_fields(R.parse(F.col("t")), R.parse(F.col("r"))).alias("u")).first().u
    assert [(u.key, u.value) for u in got] == [("A", "3"), ("B", "2")]


def issues(spark, report, template=TEMPLATE):
    rows = spark.createDataFrame([(report, template)], "r string, t string")
    return rows.select(R.structure_issues(F.col("r"), F.col("t")).alias("i")).first().i


def test_structure(spark):
    assert issues(spark, " \n") == issues(spark, None) == ["Report text is empty."]
    assert issues(spark, TEMPLATE) == []
    assert issues(spark, "LUNGS: a") == ["Missing top-level 'FINDINGS:' section header.", "Missing top-level 'IMPRESSION:' section header.", "Missing template fields in report: BONES"]


def warned(spark, dictation, report):
    rows = spark.createDataFrame([(dictation, report)], "d string, r string")
    return rows.select(R.fidelity_warnings(F.col("d"), F.col("r")).alias("w")).first().w


def test_fidelity(spark):
    assert warned(spark, "Bright spot", "dark") == ["Laterality 'right' present in dictation but missing in report."]
    assert warned(spark, "5 mm and 5 mm, left", "LEFT 6 mm") == ["Measurement '5 mm' from dictation not found in report."] * 2
    assert warned(spark, None, None) == []


def route(spark, template, dictation):
    rows = spark.createDataFrame([(template, dictation)], "t string, d string").withColumn("p", R.parse(F.col("t")))
    r = rows.select(R.routed(F.col("p.fields"), F.col("p.impression"), F.col("d")).alias("r")).first().r
    return [(u.key, u.value) for u in r.updates], r.impression


def test_routing(spark):
    template = "FINDINGS:\nLUNGS: clear\nBONES: ok\nOTHER FINDINGS: none\nIMPRESSION:\nNormal."
    assert route(spark, template, " Normal ") == ([], "Normal.")
    assert route(spark, template, "") == ([], "Normal.")
    assert route(spark, template, "...") == ([], "Normal.")
    assert route(spark, template, "the lungs are Dense. lungs wet; rib BROKEN") == ([("LUNGS", "Lungs wet"), ("OTHER FINDINGS", "rib BROKEN")], "the lungs are Dense lungs wet rib BROKEN")
    assert route(spark, "FINDINGS:\nLUNGS: clear", "rib broken") == ([], "rib broken")
