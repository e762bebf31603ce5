"""The contract with the driver, and every query with SQL against it on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_each_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return c


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(compare.canonical(r[c]) for c in cols) for r in (x.asDict(recursive=True) for x in df.collect())), key=repr)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    theirs = sorted((tuple(compare.canonical(dict(zip(rel.columns, r, strict=True))[c]) for c in cols) for r in rel.fetchall()), key=repr)
    assert mine == theirs
