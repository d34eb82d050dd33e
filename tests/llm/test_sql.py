"""The registered queries against their SQL, as the views that a checker makes of it."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as se
from conftest import SF001, SF01
from mktpulse.llm.queries import ORACLE_SQL


@pytest.mark.parametrize("sf", [SF001, SF01])
@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, key, sf):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    con.execute(f"CREATE VIEW o AS {ORACLE_SQL[key]}")
    res = con.execute("SELECT * FROM o")
    names = [c[0] for c in res.description]
    want = sorted(map(str, res.fetchall()))
    got = se.queries()[key](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == want
