import glob

import pytest

from editspark.sources import scratch


def files(spark):
    return glob.glob(scratch.shared_dir(spark).removeprefix("file:") + "/editspark-*")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_join_like_others(spark, monkeypatch, how):
    left = spark.createDataFrame([(k % 7 if k % 3 else 99, k) for k in range(60)] + [(None, 60), (None, 61), (55, 62)], "id int, v int")
    right = spark.createDataFrame([(k, f"n{k}", k * 1.5) for k in [*range(5), 99, 200]] , "id int, name string, x double")
    expected = sorted(map(str, left.join(right, "id", how).collect()))
    assert sorted(map(str, scratch.hot_joined(left, right, "id", how).collect())) == expected
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(scratch, "HOT_ROWS", 10)
    out = scratch.hot_joined(left, right, "id", how)
    assert sorted(map(str, out.collect())) == expected and out.columns == ["id", "v", "name", "x"]


def test_scratch_tables_go_and_kept_ones_stay(spark):
    before = set(files(spark))
    with scratch.scratch(spark) as kept:
        a = scratch.written(spark.range(5), "a")
        with scratch.scratch(spark) as inner:
            b = inner(a.selectExpr("id + 1 AS id"), "b")
        c = kept(b, "c")
        assert len(set(files(spark)) - before) == 3
    assert [f.split("editspark-")[-1][0] for f in set(files(spark)) - before] == ["c"] and c.count() == 5


def test_sizes_count_bytes(spark):
    rows = spark.createDataFrame([("x" * 1000, 1), (None, 2)], "t string, n int")
    assert 1000 <= scratch.bytes_of(rows) <= 1100 and scratch.bytes_of(rows.limit(0)) == 0
