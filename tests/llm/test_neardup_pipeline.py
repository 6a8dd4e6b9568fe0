import random
import re

import numpy as np
import pytest

import corpus_pipeline
from editspark.llm import neardup
from editspark.llm.components import components
from editspark.sources import scratch

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_force(pairs):
    """Least reachable id of every id, by comparing all pairs of sets."""
    sets = {i: shingle_set(t) for i, t in pairs}
    group = {i: i for i in sets}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and group[a] != group[b] and 100 * len(x & y) >= 85 * len(x | y):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return sets, group


def check(rows, pairs):
    sets, group = brute_force(pairs)
    got = {r.doc_id: r for r in rows}
    assert set(got) == set(sets) and len(rows) == len(pairs)
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == group
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_the_sample(sample):
    check(neardup.near_duplicates(sample).collect(), [(r.doc_id, r.text) for r in sample.collect()])


def test_brute_force_in_sql(sample):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    _, group = brute_force([(r.doc_id, r.text) for r in sample.collect()])
    assert {i: (c, k) for i, _, c, k in con.sql(neardup.sql()).fetchall()} == {i: (c, i == c) for i, c in group.items()}


def text(n, seed):
    draw = random.Random(seed)
    return [f"w{draw.randrange(10_000)}" for _ in range(n)]


def edited(words, changes, seed):
    draw, out = random.Random(seed), list(words)
    for _ in range(changes):
        out[draw.randrange(len(out))] = f"e{draw.randrange(10_000)}"
    return out


def test_groups_of_copies_larger_than_leaves(docs_of):
    base = text(300, 0)
    texts = [" ".join(base)] * 150 + [" ".join(edited(base, 1 + k % 3, k)) for k in range(400)]
    texts += [" ".join(text(60, 1) + text(200, 100 + k)) for k in range(150)]  # a shared passage, but different documents
    texts += [" ".join(edited(text(200, 100), k, 7 + k)) for k in range(5)]
    pairs = [(2 * k + 1, t) for k, t in enumerate(texts)]
    rows = neardup.near_duplicates(docs_of(pairs)).collect()
    sets, group = brute_force(pairs)
    wrong = [r.doc_id for r in rows if r.component_id != group[r.doc_id]]
    assert len(wrong) <= 0.01 * len(rows), wrong
    assert len({r.component_id for r in rows}) <= 1.01 * len(set(group.values()))


def test_variants_of_an_absent_text_equal_brute_force(docs_of):
    """A large group in which each document is linked to few others: too alike to be split, not copies of one text."""
    base, texts = text(300, 0), []
    for k in range(150):
        mine = edited(base, 4, k)
        texts += [" ".join(mine), " ".join(edited(mine, 2, 1000 + k))]
    pairs = list(enumerate(texts))
    rows = neardup.near_duplicates(docs_of(pairs)).collect()
    check(rows, pairs)
    assert len({r.component_id for r in rows}) > 70


def test_texts_that_share_a_long_passage(docs_of):
    """450 of 500 shingles are common to all: any two texts are 0.82 alike, which is no link; in some pairs more is shared."""
    shared, texts = text(454, 0), []
    for k in range(400):
        mine = text(46, 1 + k)
        texts += [" ".join(shared + mine), " ".join(shared + mine[:20] + text(26, 10_000 + k))] if k < 60 else [" ".join(shared + mine)]
    pairs = list(enumerate(texts))
    rows = neardup.near_duplicates(docs_of(pairs)).collect()
    check(rows, pairs)
    assert len({r.component_id for r in rows}) == 400


def test_leaves_send_members_and_never_pairs(spark):
    draw = np.random.default_rng(4)
    base = draw.integers(0, 1 << 62, 2)
    rows = [(t, k, 100, int(base[0]) ^ (1 << (k % 5)), int(base[1])) for t in range(3) for k in range(60)]
    rows += [(9, 100 + k, 100, int(draw.integers(0, 1 << 62)), int(draw.integers(0, 1 << 62))) for k in range(40)]
    got = neardup.promising(spark.createDataFrame(rows, neardup.NODES)).collect()
    assert sorted(r.item for r in got) == list(range(60)) and len({r.unit for r in got}) == 1  # the three leaves' cluster once, and no row of others


def test_rows_that_share_an_id_are_classes_of_their_own_texts(docs_of):
    one, other = " ".join(text(80, 1)), " ".join(text(80, 2))
    rows = neardup.near_duplicates(docs_of([(1, one), (1, other), (5, one), (6, one), (7, other), (8, other)])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == [(1, 1, True), (1, 1, True), (5, 1, False), (6, 1, False), (7, 1, False), (8, 1, False)]


def test_blocks_share_what_sets_share():
    draw = random.Random(5)
    sets = [np.unique(np.array([draw.randrange(400) for _ in range(draw.randrange(1, 300))], np.uint64)) for _ in range(30)]
    assert neardup.shared(sets[:18], sets[18:]).tolist() == [[len(np.intersect1d(a, b)) for b in sets[18:]] for a in sets[:18]]


def test_odd_texts(docs_of):
    texts = [None, "", " \t\n", "One two", "one  TWO", "two one", "ÀB c d e f", "àb c d e f", "a b c d e", "a b c d e", "x " * 40_000, "x\xa0y z q r s", "X\xa0Y z q r s"]
    check(neardup.near_duplicates(docs_of(texts)).collect(), list(enumerate(texts)))
    assert neardup.near_duplicates(docs_of([])).count() == 0


def test_repeated_and_missing_ids(docs_of):
    rows = neardup.near_duplicates(docs_of([(5, "a b c"), (5, "a b c"), (3, "a b c"), (None, "a b c"), (None, "a b c"), (9, "z")])).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in rows) == [(-1, None, True)] * 2 + [(3, 3, True), (5, 3, False), (5, 3, False), (9, 9, True)]


def test_threshold_is_exact():
    a = np.arange(100, dtype=np.uint64)
    assert neardup.similar(a, a[:85]) and not neardup.similar(a, a[:84])
    assert neardup.similar(a[8:], a[: len(a) - 8]) == (84 * 100 >= 85 * 100)


def test_signatures_estimate_similarity():
    a = neardup.shingles(" ".join(text(800, 3)))
    b = neardup.shingles(" ".join(edited(text(800, 3), 12, 4)))
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((neardup.signature(a) == neardup.signature(b)).mean() - exact) < 0.12


@pytest.mark.parametrize("limits", [(64 << 20, 200_000), (0, 3)])
def test_components(spark, monkeypatch, limits):
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", limits[0])
    monkeypatch.setattr(scratch, "HOT_ROWS", limits[1])
    draw = random.Random(2)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(draw.randrange(200, 300), draw.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    group = {}
    for a, b in links:
        if a != b:
            x, y = group.setdefault(a, {a}), group.setdefault(b, {b})
            if x is not y:
                x |= y
                for i in y:
                    group[i] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: min(g) for i, g in group.items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def stages(spark, sample):
    out, docs = [sample], sample
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        out.append(docs)
    return out


def test_stages_keep_columns_and_rows_as_they_were(stages, sample):
    before = {r.doc_id: r for r in sample.collect()}
    for docs in stages[1:-1]:
        rows = docs.collect()
        assert docs.columns == sample.columns
        assert all(before[r.doc_id] == r for r in rows) and len({r.doc_id for r in rows}) == len(rows)
        before = {r.doc_id: r for r in rows}
        assert before


def test_one_of_each_group_stays(stages):
    _, group = brute_force([(r.doc_id, r.text) for r in stages[2].collect()])
    assert {r.doc_id for r in stages[3].collect()} == set(group.values())


def test_the_last_stage_packs_what_is_left(spark, stages):
    assert {r.doc_id for r in stages[4].collect()} == {r.doc_id for r in stages[3].collect()}
    whole = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert whole == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in stages[4].collect())


def test_stages_take_nulls_repeats_and_empty_tables(spark, docs_of):
    docs = docs_of([(1, "some words here"), (1, "some words here"), (2, None), (None, "some words here"), (4, "123")], lang={1: "en"})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    left = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 1, 2, 4]


def test_texts_that_share_an_id_are_each_judged_by_their_own_group(spark, docs_of):
    one, other = " ".join(text(80, 1)), " ".join(text(80, 2))
    near = " ".join(edited(one.split(), 1, 5))
    docs = docs_of([(1, one), (1, near), (1, other), (2, one), (3, other), (1, one), (4, None), (4, None)])
    left = sorted((r.doc_id, r.text or "") for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect())
    assert len(left) == 3 and left[-1] == (4, "") and (1, other) in left and {(1, one), (1, near)} & set(left)
