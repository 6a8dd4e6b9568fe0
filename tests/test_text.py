import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from editspark.functions import metric
from editspark.functions import text as T

NORMALISED = {
    "": "",
    "L4-L5": "l 4 l 5",
    "5mm": "5 mm",
    "5-10": "5 -10",
    "1.5 cm mass": "5 cm mass",
    "-5 units": "5 units",
    "mass 1.5 cm": "mass 1.5 cm",
    "at 3.2-cm": "at 3 2 cm",
    "at 3.2cm": "at 3.2 cm",
    "a-b-c": "abc",
    "air-space": "airspace",
    "10 millimeters,": "10 mm",
    "millimeter-sized": "millimetersized",
    "café café": "caf caf",
    "a b c": "a b c",
    "one\rtwo * three\n2) four": "one two three four",
    "value 5+": "value 5",
    "(no) \"acute\" [finding]!": "no acute finding",
    "• point\n- other": "point other",
    "+5 -2.5": "+5 -2.5",
    "K": "k",
}


def test_normalised_goldens(spark):
    rows = spark.createDataFrame([(k, v) for k, v in NORMALISED.items()], "raw string, expected string")
    got = rows.select("raw", "expected", T.normalize_text(F.col("raw")).alias("got")).collect()
    assert {r.raw: r.got for r in got} == NORMALISED


def test_null_and_long_texts(spark):
    rows = spark.createDataFrame([(None,), ("a " * 60_000,)], "t string")
    sizes = [r.n for r in rows.select(F.size(T.tokens(F.col("t"))).alias("n")).collect()]
    assert sizes == [0, 60_000]


def test_words_are_looked_up_and_few_are_kept(spark, monkeypatch):
    """Tokens need no pattern over whole texts, and a bound on words that are kept changes none."""
    rows = spark.createDataFrame([(k,) for k in NORMALISED], "t string")
    plan = rows.select(T.tokens(F.col("t")))._jdf.queryExecution().toString()
    assert "regexp" not in plan
    monkeypatch.setattr(T, "KEPT_WORDS", 2)
    assert {k: " ".join(T.Tokens().of(k)) for k in NORMALISED} == NORMALISED
    kept = T.Tokens()
    assert " ".join(kept.of("a b-c 5mm, d e f 7cm")) == "a bc 5 mm d e f 7 cm"
    assert len(kept) <= 3
    assert [x.tf for x in rows.limit(1).select(T.counted_terms(F.lit("ab ab ab")).alias("c")).first().c] == [3, 2]


def test_token_weights(spark):
    given_weights = {"no": 4.0, "the": 0.25, "lung": 2.0, "+5": 4.0, "2.5": 4.0, "": 0.0, "mm": 4.0, "2.": 2.0}
    rows = spark.createDataFrame([(k,) for k in given_weights], "t string").select("t", T.token_weight(F.col("t")).alias("w")).collect()
    assert {r.t: r.w for r in rows} == given_weights
    assert {t: metric.weight_of(t) for t in given_weights} == given_weights


def test_sentences_and_capitals(spark):
    row = spark.range(1).select(T.sentences(F.lit(" A 1.5 cm node; clear.  ")).alias("s"), T.capitalize(F.lit("aBC dE")).alias("c"), T.measurements(F.lit("5 MM and 1.5cm, x12mm")).alias("m")).first()
    assert row.s == ["A 1", "5 cm node", "clear"]
    assert row.c == "Abc de"
    assert row.m == ["5 mm", "1.5cm"]


DISTANCES = [([], [], 0.0), ([], ["lung"], 1.0), (["lung"], [], 1.0), (["lung"], ["lung"], 0.0), (["no"], ["the"], 1.0), (["no", "lung"], ["lung"], 4 / 6), (["the", "lung"], ["no", "lung"], 4 / 6)]


def test_edit_distance(spark):
    rows = spark.createDataFrame([(k, *d) for k, d in enumerate(DISTANCES)], "k int, a array<string>, b array<string>, expected double")
    for r in rows.select("k", "expected", metric.edit_distance(F.col("a"), F.col("b")).alias("got")).collect():
        assert r.got == pytest.approx(r.expected), DISTANCES[r.k]


def plain_cost(a, b):
    """The full matrix, by definition."""
    w = metric.weight_of
    table = {(0, 0): 0.0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = [table[0, 0]] if i == j == 0 else []
            if i:
                ways.append(table[i - 1, j] + w(a[i - 1]))
            if j:
                ways.append(table[i, j - 1] + w(b[j - 1]))
            if i and j:
                ways.append(table[i - 1, j - 1] + (0 if a[i - 1] == b[j - 1] else max(w(a[i - 1]), w(b[j - 1]))))
            table[i, j] = min(ways)
    return table[len(a), len(b)]


some_tokens = st.lists(st.sampled_from(["no", "the", "lung", "5", "node", "of", "left"]), max_size=9)


@settings(max_examples=200, deadline=None)
@given(some_tokens, some_tokens)
def test_cost_is_the_least(a, b):
    cost, back = metric.costs_of([(a, b), (b, a)])
    assert cost == back == plain_cost(a, b) == metric.by_loops(a, b)
    assert (cost == 0) == (a == b)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(some_tokens, some_tokens), max_size=12), st.sampled_from([1, 16, 1 << 14]))
def test_pairs_together_and_one_by_one_agree(pairs, together):
    held, metric.TOGETHER = metric.TOGETHER, together
    try:
        assert metric.costs_of(pairs) == [metric.by_loops(a, b) for a, b in pairs]
    finally:
        metric.TOGETHER = held


def test_leaving_tokens_out_needs_no_table(monkeypatch):
    words = ["no", "the", "5", "left"] + [f"w{k}" for k in range(5000)]
    thinned = [w for k, w in enumerate(words) if k % 7 != 3]
    monkeypatch.setattr(metric, "together", None)
    assert metric.costs_of([(words, thinned), (thinned, words), (words[1:3], words[:4])]) == [2.0 * 714 + 4.0, 2.0 * 714 + 4.0, 8.0]


def test_compared_texts_equal_distances_of_their_tokens(spark):
    texts = [None, "", " ", "No mass.", "no mass", "no the mass", "left 5 mm node", "node left 4 mm", "1) the lung", "the lung"]
    rows = spark.createDataFrame([(a, b, c or "") for a in texts for b in texts for c in texts], "a string, b string, c string")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    a, b, c = T.tokens(F.col("a")), T.tokens(F.col("b")), T.tokens(F.col("c"))
    expected = rows.select("*", F.when(both, metric.edit_distance(a, b)).otherwise(1.0).alias("e"), (F.col("a").isNotNull() & (a != c)).alias("x"))
    got = expected.withColumn("m", metric.compared(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert len(got) == 1000 and all((r.m.edit, r.m.changed) == (r.e, r.x) for r in got)


def test_long_lists():
    a = [f"w{k % 17}" if k % 5 else "no" for k in range(120)]
    b = [t for k, t in enumerate(a) if k % 7 != 3] + ["left"]
    c = [f"c{k}" for k in range(3000)]
    pairs = [(a, b), (b, a), (a, []), ([], b), (c, a), (a[:3], c), (c, [*c[:1500], "no", *c[1500:2999]])]
    assert metric.costs_of(pairs) == [plain_cost(x, y) for x, y in pairs]


def test_whole_text_rules_equal_word_by_word_rules(spark):
    """The one-pass form against the rules applied to each line and word, as the SQL form states them."""
    import random

    import duckdb
    import pandas as pd

    from editspark.plans.oracle import tokens as sql_tokens

    random.seed(4)
    parts = ["a", "bc", "5", "12", ".", "-", "+", " ", "  ", "\n", "\n\n", "(", ")", ",", "mm", "millimeters", "centimetre", "•", "1)", "2.", "é", " ", " ", '"', "'", "*", "x-y", "\t", "٣", "\r\n", "\x1f", "3.5"]
    texts = ["".join(random.choice(parts) for _ in range(random.randrange(1, 14))) for _ in range(4000)]
    pdf = pd.DataFrame({"k": range(len(texts)), "t": texts})
    expected = dict(duckdb.sql(f"SELECT k, {sql_tokens('t')} FROM pdf").fetchall())
    got = {r.k: r.toks for r in spark.createDataFrame(pdf).select("k", T.tokens(F.col("t")).alias("toks")).collect()}
    wrong = [(texts[k], got[k], expected[k]) for k in expected if got[k] != expected[k]]
    assert not wrong, wrong[:5]


def test_hashes_of_terms_tell_terms_apart():
    """Runs and pairs in turn, wherever they stand in a text: once a term, one hash."""
    seen, back = {}, {}
    for text in ("ab ab ab", "x ab, cd_é ünï 12 ab cd_é", "ab" * 40_000 + " ab ünï", "", ". a", "ab abab ababab bb aa ba"):
        runs = re.findall(r"\w{2,}", text)
        terms = runs + [f"{a} {b}" for a, b in itertools.pairwise(runs)]
        found = T.hashes_of_terms(text).tolist()
        assert len(found) == len(terms)
        for term, h in zip(terms, found, strict=True):
            assert seen.setdefault(term, h) == h and back.setdefault(h, term) == term


def test_words_that_come_once_are_not_kept():
    """Before, every distinct word was looked up among all met and kept."""
    known = T.Tokens()
    text = "Atreea, réeux 3cm atreea RÉEUX Millimeter (x)"
    assert known.of(text) == ["atreea", "r", "eux", "3", "cm", "atreea", "r", "eux", "mm", "x"] and set(known) == {"3cm"}
    assert list(known.counted(text).items()) == [("atreea", 2), ("r", 2), ("eux", 2), ("3", 1), ("cm", 1), ("mm", 1), ("x", 1)]
