"""Every registered query that has SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from editspark.functions.sql import register_functions, register_views
from editspark.plans import fixtures
from editspark.plans.oracle import oracle_sql
from editspark.plans.queries import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(pdf):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return repr(round(v, 6)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(plain, r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, duck, name):
    got, expected = queries()[name](spark, DATA).toPandas(), duck.sql(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    assert queries()[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["bm25_index", "parse_fields", "render_report", "heuristic_route", "merge_submission"])
def test_filters_and_columns_reach_the_scan(spark, name):
    plan = queries()[name](spark, DATA)._jdf.queryExecution().toString()
    assert "n_chars" not in plan[plan.index("Physical Plan") :].split("ReadSchema")[-1]
    assert "Cartesian" not in plan


def test_views_and_functions(spark):
    assert register_views(fixtures.cases(spark, DATA)) == ["case_fields", "case_tokens", "case_sentences"]
    assert spark.sql("SELECT count(*) AS n FROM case_fields WHERE key LIKE 'T0%'").first().n > 0
    register_functions(spark)
    assert spark.sql("SELECT es_token_weight('no') AS w, es_standard_unit('millimeters') AS u, es_capitalize('aB') AS c, es_measurements('5 mm') AS m").first() == (4.0, "mm", "Ab", ["5 mm"])
