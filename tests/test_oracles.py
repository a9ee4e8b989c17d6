"""Every query that has SQL gives the rows of its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from loomtrace.plans import registry

FOLDER = os.environ.get("LOOMTRACE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        return f"{v:.6f}" if isinstance(v, float) else "\0" if v is None else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, tables, name):
    df = registry.QUERIES[name](spark, FOLDER)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    cur = tables.execute(registry.SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == plain(cur.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0
