"""Every registered query with SQL against DuckDB on the same tables."""

import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    rel = db.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    assert got == sorted(repr(tuple(r[k] for k in order)) for r in rel.fetchall())


def test_entry_runs(spark):
    if os.path.isdir(SF):
        assert entry.entry(spark).count() > 0
