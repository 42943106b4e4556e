import collections
import hashlib
import random

import pytest
from cases import docs, empty

from tidemark.llm import repeats


def brute(rows):
    """rows: (doc_id, text); repeated rows are the same document, null ids are last."""
    order = sorted({(repeats.NULL if i is None else i, t or "") for i, t in rows})
    seen, out = set(), {}
    for key in order:
        b = key[1].encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out[key] = (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest(), left)
    return out


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute(rows)
    key = lambda i, t: (repeats.NULL if i is None else i, t or "")
    got = collections.Counter(map(tuple, repeats.report(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == collections.Counter((i, *want[key(i, t)][:4]) for i, t in rows)


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 8)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(r.choice((15, 30, 60))) for _ in range(5)]
    rows = []
    for i in range(n):
        t = text(r.choice((3, 20, 80)))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, 20)
            p = p[a : len(p) - r.randint(0, 20)]
            t += r.choice((" ", "\n", "")) + p + text(r.choice((0, 5)))
        if r.random() < 0.3 and rows:
            t = rows[r.randrange(len(rows))][1]
            if r.random() < 0.6:
                k = r.randrange(len(t) + 1)
                t = t[:k] + word() + t[k:]
        if r.random() < 0.1:
            t += r.choice(("a" * 400, "ab" * 300, "x y " * 100))
        rows.append((i, t, "en", "s"))
    r.shuffle(rows)
    return rows


def test_cases(spark):
    df = docs(spark)
    check(df)
    assert repeats.report(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_brute(spark, seed):
    check(docs(spark, corpus(seed)).repartition(3))


def test_hot_and_many(spark, monkeypatch):
    for name, value in (("MANY", 2), ("HOT", 3), ("CHUNK", 3000), ("PIECE", 500), ("PART", 300)):
        monkeypatch.setattr(repeats, name, value)
    check(docs(spark, corpus(3)).repartition(3))


def test_hot_passage(spark, monkeypatch):
    """One passage in every text, at odd places: its edges are hot anchors in many parts, and no part's windows are joined with all copies."""
    monkeypatch.setattr(repeats, "HOT", 20)
    r = random.Random(11)
    passage = " ".join(f"w{r.randrange(10**6)}" for _ in range(40))
    rows = [(i, f"{r.random()} {'x' * r.randrange(9)}{passage}{r.random()}", "en", "s") for i in range(400)]
    check(docs(spark, rows).repartition(5))


def test_clean_keeps_columns(spark):
    """Columns named like the operator's own come back as they were."""
    text = "abc " * 60
    names = ("d", "v", "bytes", "left", "_0", "start", "h", "n_chars")
    df = spark.createDataFrame([(i, text + str(i), *[f"{n}{i}" for n in names[:-1]], 7) for i in range(3)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names[:-1]) + ", n_chars long")
    got = repeats.clean(df).collect()
    assert {r.doc_id for r in got} >= {0} and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names[:-1]) and all(r.n_chars == len(r.text) for r in got)


def test_long_pieces():
    import numpy as np
    import pyarrow as pa

    t = "".join(random.Random(4).choice("ab ") for _ in range(3_000_000))
    whole = repeats.stretches(*repeats.B.column(pa.array([t])))
    assert len(whole[0]) > 50_000
    old, repeats.PIECE = repeats.PIECE, 1_000_000
    found = {(s + shift, h) for _, data, offsets, shift in repeats.pieces(pa.array([t])) for s, h in zip(*(x.tolist() for x in np.array(repeats.stretches(data, offsets), dtype=object)[[0, 3]]))}
    repeats.PIECE = old
    assert {(s, h) for s, h in zip(whole[0].tolist(), whole[3].tolist())} <= found


def test_clean(spark):
    rows = corpus(7)
    df = docs(spark, rows)
    want = {k[0]: v[4].decode("utf-8", "ignore") for k, v in brute([r[:2] for r in rows]).items()}
    got = repeats.clean(df)
    assert got.columns == df.columns
    got = got.collect()
    assert {r.doc_id: r.text for r in got} == {i: t for i, t in want.items() if t or not dict((r[0], r[1]) for r in rows)[i]}
    assert all(r.n_chars == len(r.text) for r in got)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {k[0]: v for k, v in brute(rows).items()}
    for r in repeats.op10_repeated_passages(spark, sf).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id][:4]
