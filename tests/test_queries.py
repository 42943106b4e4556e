"""Every query of the catalogue against its SQL twin, in DuckDB on the same files."""

import math

import duckdb
import pytest

from tidemark.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sql(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v
    return sorted((tuple(clean(v[k]) for k in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_twin(spark, sf, sql, name):
    got = Q.QUERIES[name](spark, sf)
    want = sql.sql(Q.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


def test_entry_imports_and_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(Q.QUERIES)
    assert entry.entry(spark).count() > 0


def test_snapshot_json(spark, sf):
    import json

    (row,) = Q.snapshot_json(spark, sf).collect()
    doc = json.loads(row.document)
    assert len(doc["partitions"]) == 12 and doc["assigned"] <= 12


def test_pushdown_and_pruning(spark, sf):
    plan = Q.prev_offset_chain(spark, sf)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan
