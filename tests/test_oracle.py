"""Every query with SQL against DuckDB on the smallest tables; those without run and keep their schema."""

import glob
import os

import duckdb
import pytest

from tidewire.plans.catalog import ALL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(row):
    return tuple(float(f"{float(x):.9g}") if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in row)


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if sql])
def test_matches_sql(spark, duck, name):
    query, sql = ALL[name]
    df = query(spark, SF)
    columns = sorted(df.columns)
    got = sorted((plain(r[c] for c in columns) for r in df.collect()), key=repr)
    said = duck.execute(sql)
    names = [d[0] for d in said.description]
    assert sorted(names) == columns
    want = sorted((plain(r[names.index(c)] for c in columns) for r in said.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if not sql])
def test_runs(spark, name):
    assert ALL[name][0](spark, SF).count() > 0
