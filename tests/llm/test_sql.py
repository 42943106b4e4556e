"""Queries against their SQL twins, in DuckDB on the same files."""

import duckdb
import pytest

from tidemark.llm import queries


@pytest.mark.parametrize("name", ["op4_chat_format", "op10_repeated_passages"])
def test_twin(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = c.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
