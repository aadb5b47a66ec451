"""Every registered query with SQL agrees with DuckDB; the others return rows."""

import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    yield con
    con.close()


def canonical(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(([r[i] for i in order] for r in data), key=lambda r: [(x is not None, x) for x in r])


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert got
        return
    cur = duck.execute(SQL[name])
    want = cur.fetchall()
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    a, b = canonical(df.columns, got), canonical(cols, want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(same(p, q) for p, q in zip(x, y, strict=True)), (x, y)


def test_entry_runs(spark):
    df = entry(spark)
    assert df.columns[:3] == ["recid", "uid", "state"]
    assert df.count() > 0


def test_names_and_sql_cover_each_other():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) >= 190
    assert os.path.isdir(SMALL)
