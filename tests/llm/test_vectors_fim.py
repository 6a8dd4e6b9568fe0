import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from editspark.llm import fim, vectors

SMALL = "/root/testdata/sf0.001"
SPEC = "vec_id long, label int, embedding array<double>, item string, n int, key string"


@pytest.fixture(scope="session")
def vectors_of(spark):
    """A table of vectors of (id, label, components); further columns have names that the operator uses itself."""
    return lambda rows: spark.createDataFrame([(i, label, None if v is None else [None if x is None else float(x) for x in v], "x", 1, None) for i, label, v in rows], SPEC)


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_force(rows):
    """Links of each row, and least reachable id of each row."""
    known = [k for k, (i, label, v) in enumerate(rows) if i is not None and label is not None and usable(v)]
    partners = {k: set() for k in range(len(rows))}
    for width in {len(rows[k][2]) for k in known}:
        some = [k for k in known if len(rows[k][2]) == width]
        m = vectors.directed(np.array([rows[k][2] for k in some], np.float64))
        label = np.array([rows[k][1] for k in some])
        for a, b in zip(*np.nonzero((m @ m.T >= vectors.LEAST) & (label[:, None] == label[None])), strict=True):
            if a != b:
                partners[some[a]].add(some[b])
    least, seen = [i for i, _, _ in rows], set()
    for k in known:
        if k in seen:
            continue
        group, todo = {k}, [k]
        while todo:
            new = partners[todo.pop()] - group
            group |= new
            todo += new
        seen |= group
        for x in group:
            least[x] = min(rows[y][0] for y in group)
    return [len(partners[k]) for k in range(len(rows))], least


def check(got, rows, recall=1.0):
    links, least = brute_force(rows)
    got, expected = {r.vec_id: r for r in got}, {i: (n, c) for (i, _, _), n, c in zip(rows, links, least, strict=True)}
    assert set(got) == set(expected)
    assert all(got[i].n_links <= n for i, (n, _) in expected.items())
    assert sum(r.n_links for r in got.values()) >= recall * sum(links)
    assert sum(got[i].component_id != c for i, (_, c) in expected.items()) <= (1 - recall) * len(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got.values())


def turned(base, cosine, draw):
    side = draw.standard_normal(len(base))
    side -= side @ base * base
    return cosine * base + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)


def test_pairs_around_the_threshold(vectors_of):
    draw = np.random.default_rng(5)
    base = vectors.directed(draw.standard_normal((1500, 64)))
    rows = []
    for k, v in enumerate(base):
        rows += [(2 * k, k % 2, v), (2 * k + 1, k % 2, turned(v, draw.uniform(0.9, 0.97), draw))]
    check(vectors.near_duplicates(vectors_of(rows)).collect(), rows, 0.98)


@pytest.mark.parametrize("unit", [32, 2048])
def test_large_lists_meet_in_blocks(vectors_of, monkeypatch, unit):
    monkeypatch.setattr(vectors, "UNIT", unit)
    draw = np.random.default_rng(6)
    base = vectors.directed(draw.standard_normal((200, 16)))
    alike = [turned(base[0], draw.uniform(0.955, 1), draw) for _ in range(400)]
    rows = [(1000 - k, 1, v) for k, v in enumerate([*alike, *[3 * base[1]] * 150, *[base[1] + 0.01] * 3, *base])]
    check(vectors.near_duplicates(vectors_of(rows)).collect(), rows, 0.98)


def test_defined_results(spark, vectors_of):
    a = [1.0, 2.0, 3.0]
    odd = [None, [], [0, 0, 0], [1, None, 2], [1, float("nan"), 2], [float("inf"), 1, 2]]
    rows = [(10 + k, 1, v) for k, v in enumerate(odd)] + [(1, 1, a), (2, 1, a), (3, 2, a), (4, None, a), (5, 1, [x * 1e300 for x in a]), (6, 1, [x * 1e-300 for x in a])]
    rows += [(7, 1, [*a, 0.0]), (8, 1, [-x for x in a]), (9, 2, [-0.0, 0.0, 1.0]), (30, 2, [0.0, 0.0, 1.0])]
    check(vectors.near_duplicates(vectors_of(rows)).collect(), rows)
    got = vectors.near_duplicates(vectors_of([(1, 1, a), (1, 1, a), (1, 1, [2, 4, 6.1]), (None, 1, a), (None, None, None)])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True)] * 2 + [(1, 2, 1, True)] * 3
    empty = vectors.near_duplicates(vectors_of([]))
    assert empty.columns == ["vec_id", "n_links", "component_id", "kept"] and empty.count() == 0
    assert vectors.near_duplicates(vectors_of([(1, None, a)])).collect()[0].n_links == 0


def test_looked_up_products_are_within_their_errors(spark, vectors_of):
    draw = np.random.default_rng(7)
    x = vectors.directed(draw.standard_normal((600, 24)))
    index = vectors.fit(x, 2000)
    assert 1 < len(index.centroids) and 1 <= index.probes <= len(index.centroids)
    home = index.lists(x.astype(np.float32), 1)[:, 0]
    codes, error = index.codes(x.astype(np.float32), home)
    for of_list in range(len(index.centroids)):
        some = home == of_list
        found = index.looked_up(x[:50].astype(np.float32), of_list, codes[some])
        assert (np.abs(found - x[:50] @ x[some].T) <= error[some] + vectors.SLACK).all()


def test_vectors_in_sql(spark, vectors_of, tmp_path):
    draw = np.random.default_rng(8)
    base = vectors.directed(draw.standard_normal((60, 8)))
    rows = [(k, k % 3 or None, turned(base[k % 20], draw.uniform(0.95, 1), draw)) for k in range(60)] + [(60, 1, None), (61, 1, [0.0] * 8), (62, 1, [None] * 8)]
    vectors_of(rows).write.parquet(f"{tmp_path}/v")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/v/*.parquet'")
    expected = {i: (n, c, c == i) for (i, _, _), n, c in zip(rows, *brute_force(rows), strict=True)}
    assert {i: rest for i, *rest in con.sql(vectors.sql()).fetchall()} == {i: list(x) for i, x in expected.items()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5000), unique=True, max_size=80), st.integers(0, 20))
def test_elias_fano(numbers, shift):
    numbers = np.sort(np.array(numbers, np.int64)) << shift
    held = fim.EliasFano(fim.EliasFano.encode(numbers))
    assert [held.select(k) for k in range(len(numbers))] == numbers.tolist() and held.start(0) == 0
    assert len(fim.EliasFano.encode(numbers)) <= 18 + len(numbers) * (3 + (5000 << shift).bit_length()) // 8


ODD = ["", "\n", "\n\n", "a", "a\n", "a\nb", "\na", "x<P>y", "<S>", "<M>\n", "<<P", "é ü\r\n😀\n", "a\x00b\n\x85c", None]


def plainly(doc, text):
    """Units, form and pieces by the definition."""
    import hashlib
    import re

    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    hex_ = hashlib.sha256(f"7:{'null' if doc is None else doc}".encode()).hexdigest()
    h = [int(hex_[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pieces = ["".join(x) for x in (units[:low], units[low:high], units[high:])]
    if not text or re.search("<[PSM]>", text):
        return len(units), "plain", None, None, text
    p, m, s = pieces
    form, output = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return len(units), form, len(p), len(m), output


def test_fim_examples_by_definition(docs_of):
    texts = ODD + ["line of text\n" * 3000, "w" * 200_000, "\n" * 50_000, *["copy\nof\na text"] * 40]
    pairs = list(enumerate(texts)) + [(None, "a\nb\nc"), (5, "a\nb"), (5, "a\nb"), (-3, "x\ny\nz\n")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fim.examples(docs_of(pairs)).collect())
    assert got == sorted((doc is None, doc or 0, *plainly(doc, text or "")) for doc, text in pairs)
    assert all(fim.restored(plainly(doc, text or "")[4], plainly(doc, text or "")[1]) == (text or "") for doc, text in pairs)
    assert fim.examples(docs_of([])).count() == 0
    assert {r.form for r in fim.examples(docs_of(pairs), rate=0).collect()} == {"plain"}
    assert {r.form for r in fim.examples(docs_of(pairs), spm=100).collect()} == {"plain", "spm"}


def test_fim_restores_texts_that_imitate_sentinels(docs_of):
    texts = [a + "\n" + b for a in ("<", "<S", "<P", "S>", "<M", "M>") for b in ("<", "S>", ">", "P>\n<", "M>\n<S")]
    for r in fim.digests(docs_of(list(enumerate(texts)))).collect():
        import hashlib

        assert r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_fim_index_has_each_text_once(docs_of):
    rows = fim.index(docs_of(["a\nb", "a\nb", "a\nb\n", "", None, "c"])).collect()
    assert sorted((r.copies, r.n) for r in rows) == [(1, 1), (1, 2), (2, 0), (2, 2)]


def test_fim_in_sql(spark, docs_of, tmp_path):
    docs_of(list(enumerate(t for t in ODD if t is None or "\x00" not in t))).write.parquet(f"{tmp_path}/d")
    for path in (f"{SMALL}/documents.parquet", f"{tmp_path}/d/*.parquet"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
        found = con.sql(fim.sql())
        got = fim.digests(spark.read.parquet(path)).select(found.columns)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, found.fetchall()))
