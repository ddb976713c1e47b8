"""Training-data queries with SQL give DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from sparsewell.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v or 0) for v in r))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_equal_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in found.fetchall()]
    assert ordered(tuple(r[c] for c in cols) for r in df.collect()) == ordered(want)
