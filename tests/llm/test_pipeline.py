"""The stages one after another, each against the brute-force version of its operator."""

import collections
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_minhash import brute as near
from test_outliers import brute as quality
from test_repeats import brute as repeats
from test_repeats import brute as brute_repeats
from test_tokens import WORDS, ids_of

from tidemark.llm import mixing


def test_stages(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    names = df.columns
    stages = [f for _, f in corpus_pipeline.STAGES]
    one = stages[0](spark, df, sf)
    good = {k[0] for k in quality([(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]) if k[-1]}
    rows = one.collect()
    assert one.columns == names and {r.doc_id for r in rows} == good
    two = stages[1](spark, one, sf)
    first = {k[0] for k in near([(r.doc_id, r.text) for r in rows]) if k[-1]}
    rows = two.collect()
    assert two.columns == names and {r.doc_id for r in rows} == first
    three = stages[2](spark, two, sf)
    left = {k[0]: v[4].decode("utf-8", "ignore") for k, v in repeats([(r.doc_id, r.text) for r in rows]).items()}
    rows = three.collect()
    assert three.columns == names and {r.doc_id: r.text for r in rows} == {i: t for i, t in left.items() if t}
    four = stages[3](spark, three, sf)
    many = {r.doc_id: r.mix_copies for r in mixing.mix(three).collect()}
    assert four.columns == names and collections.Counter(r.doc_id for r in four.collect()) == collections.Counter({i: n for i, n in many.items() if n})
    five = stages[4](spark, four, sf).collect()
    total = collections.Counter()
    for p in five:
        total[p.doc_id] += p.length
    texts = {r.doc_id: r.text for r in rows}
    assert total == collections.Counter({i: n * len(ids_of(WORDS, texts[i], 2)) for i, n in many.items() if n})
    by = collections.defaultdict(int)
    for p in five:
        by[p.sequence_id] += p.length
    assert all(n & (n - 1) == 0 and n <= 4096 for n in by.values())


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 0


NAMES = ("d", "v", "bytes", "left", "_0", "mix_size", "mix_copies", "q", "distance", "grp", "x", "component_id", "kept", "text_a", "f1", "ids")


def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns named like the operators' own."""
    from cases import docs

    df = docs(spark).drop("start", "size", "ids", "h")
    for n in NAMES:
        df = df.withColumn(n, F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return df


def kept_columns(rows):
    return all(r[n] == f"{n}{'-' if r.doc_id is None else r.doc_id}" for r in rows for n in NAMES)


@pytest.mark.parametrize("k", range(4))
def test_stages_on_odd_rows(spark, sf, k):
    df = odd(spark)
    out = corpus_pipeline.STAGES[k][1](spark, df, sf)
    rows = out.collect()
    assert out.columns == df.columns and kept_columns(rows)
    before = {(r.doc_id, r.text) for r in df.collect()}
    if k in (0, 1, 3):
        assert {(r.doc_id, r.text) for r in rows} <= before
    if k == 0:  # no estimate from so few: the base rules alone decide
        assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r.doc_id for r in df.collect() if not fails(r.text))
    if k == 1:  # the long text's copies are one document; one with a word more is near it
        assert collections.Counter(r.doc_id for r in rows) == {0: 1, 1: 1, 2: 1, 3: 2, None: 2, 4: 1, 6: 1, 7: 1}
    if k == 2:
        left = brute_repeats([(r.doc_id, r.text) for r in df.collect()])
        assert {(r.doc_id, r.text) for r in rows} == {(i, t) for i, t in before if not left[key(i, t)][1]} | {(i, left[key(i, t)][4].decode("utf-8", "ignore")) for i, t in before if left[key(i, t)][1] and left[key(i, t)][4]}
    if k == 3:
        assert {r.doc_id for r in rows} >= {1, 2}
    empty = corpus_pipeline.STAGES[k][1](spark, df.where("false"), sf)
    assert empty.columns == df.columns and empty.count() == 0


def fails(text):
    """The base rules, word by word."""
    w = [x for x in re.split("[\\x20\\x09-\\x0D]+", text or "") if x]
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    repeated = {j for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    return len(w) < 50 or 100 * len(repeated) > 50 * len(w)


def key(doc_id, text):
    from tidemark.llm import repeats as R

    return R.NULL if doc_id is None else doc_id, text or ""


def test_packing_of_odd_rows(spark, sf):
    df = odd(spark)
    pieces = corpus_pipeline.STAGES[4][1](spark, df, sf).collect()
    total = collections.Counter()
    for p in pieces:
        total[p.doc_id] += p.length
    want = collections.Counter()
    for r in df.collect():
        want[r.doc_id] += len(ids_of(WORDS, r.text, 2))
    assert total == want
    assert corpus_pipeline.STAGES[4][1](spark, df.where("false"), sf).count() == 0


def test_all_stages_on_odd_rows(spark, sf, tmp_path):
    """run() over a table of its own, and over an empty one."""
    odd(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert {p.doc_id for p in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {r.doc_id for r in odd(spark).collect() if not fails(r.text)}
    odd(spark).where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
