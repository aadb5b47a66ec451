"""The queries of this subpackage: SQL twins agree at the smallest size, all return rows with plain columns."""

import duckdb
import pytest

from pointweave.llm import licenses, mixing, ngram_join, quality  # noqa: F401
from pointweave.llm.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(SQL[name])
    cols = sorted(d[0] for d in cur.description)
    want = sorted(map(repr, con.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()))
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == cols
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == want
