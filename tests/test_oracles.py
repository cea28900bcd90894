"""Every registered query with SQL must give what DuckDB gives."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SQL, SPARK = oracle_sql(), queries()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def normal(rows, cols):
    place = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(r[i] for i in place)) for r in rows)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(SPARK)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, con, name):
    df = SPARK[name](spark, sf)
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cur.fetchall(), cols)


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry(spark).count() > 0
