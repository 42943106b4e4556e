import collections
import re

import duckdb
import pytest
from cases import docs, empty

from tidemark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def levels(sizes):
    """Resharing any excess by weight until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def check(df):
    rows = df.select("doc_id", "text", "source").collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = levels(sizes)
    got = mixing.mix(df)
    assert set(df.columns) < set(got.columns)
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.mix_size == len(WORD.findall(r.text or "")) and r.mix_source_size == sizes[r.source]
        assert r.mix_target == pytest.approx(want[r.source], rel=1e-12, abs=1e-9)
        rate = r.mix_target / r.mix_source_size if r.mix_source_size else 1
        assert int(rate) <= r.mix_copies <= min(2, int(rate) + 1)
    return out


def test_cases(spark):
    check(docs(spark))
    assert mixing.mix(empty(spark)).count() == 0 and mixing.copies(empty(spark)).count() == 0
    check(docs(spark, [(1, None, "en", None), (2, "", "en", "a")]))


def test_near_targets(spark):
    rows = [(i, "w " * (1 + i * i % 50), "en", "abcdefg"[min(6, i % 11)] if i % 13 else None) for i in range(6000)]
    out = check(docs(spark, rows))
    taken, target = collections.Counter(), {}
    for r in out:
        taken[r.source] += r.mix_size * r.mix_copies
        target[r.source] = r.mix_target
    assert all(abs(taken[s] - t) <= 0.12 * t for s, t in target.items())


def test_copies(spark):
    df = docs(spark)
    many = {}
    for r in mixing.mix(df).collect():
        many[(r.doc_id, r.text)] = many.get((r.doc_id, r.text), 0) + r.mix_copies
    got = mixing.copies(df)
    assert got.columns == df.columns
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter({k: n for k, n in many.items() if n})


def test_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = c.sql(mixing.SQL)
    got = mixing.op7_mixing(spark, sf)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.select(", ".join(names)).fetchall())
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
