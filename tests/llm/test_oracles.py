"""Queries that SQL can express against their SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tidemark.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"op12_turns"}))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(str(x) for x in r) for r in df.select(*names).collect()) == sorted(tuple(str(x) for x in r) for r in found.fetchall())
