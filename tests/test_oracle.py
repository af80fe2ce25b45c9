"""Every query that has SQL gives the same rows in another engine."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert mine == sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["group_name", "base", "m", "poster", "n_rows", "first_pos"]
    assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0
