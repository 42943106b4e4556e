import collections
import math
import random
import re

import numpy as np
from cases import docs, empty

from tidemark.llm import outliers as O

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    mark = set()
    for k, g in enumerate(zip(w, w[1:], w[2:])):
        if windows[g] > 1:
            mark |= {k, k + 1, k + 2}
    n, rep = len(w), len(mark)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, n < 50 or 100 * rep > 50 * n


def x_of(text):
    n, chars, symbols, dup, rep, _ = base(text)
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    v = [math.log(max(1, n)), math.log(max(1, chars) / max(1, n)), symbols / max(1, n), dup / max(1, len(lines)), rep / max(1, n), math.log(max(1, len(set(w))) / max(1, n))]
    return np.rint(np.array(v) * O.UNIT) / O.UNIT


def brute(rows, least=O.LEAST):
    """doc ids to (base..., kept) by plain loops over all rows of a group."""
    groups = collections.defaultdict(list)
    for i, t, lang, source in rows:
        groups[(lang, source)].append((i, t))
    good = lambda ms: [x_of(t) for _, t in ms if not base(t)[-1]]
    out = []
    for (lang, source), members in groups.items():
        pools = [members, [m for (a, _), ms in groups.items() if a == lang for m in ms], [m for ms in groups.values() for m in ms]]
        pool = next((good(p) for p in pools if len(good(p)) >= least), None)
        estimate = fit(np.array(pool)) if pool is not None else None
        for i, t in members:
            b = base(t)
            d = 0 if estimate is None else (x_of(t) - estimate[0]) @ estimate[1] @ (x_of(t) - estimate[0])
            out.append((i, *b, not b[-1] and d <= O.chi_square_above(O.TAIL, O.D)))
    return collections.Counter(out)


def fit(x):
    cells = np.rint(np.minimum(x, 64) * 64) / 64
    median = lambda v: np.sort(v)[np.searchsorted(np.arange(1, len(v) + 1), len(v) / 2)]
    center = np.array([median(c) for c in cells.T])
    scale = np.maximum([1.4826 * median(np.abs(c - m)) for c, m in zip(cells.T, center)], O.SPREAD)
    inverse = np.diag(1 / scale**2)
    for share in [*[O.SUBSET] * O.STEPS, None]:
        d = np.einsum("ij,jk,ik->i", x - center, inverse, x - center)
        bins = np.floor(np.log2(np.maximum(d, 0) + 1e-6) * O.BINS)
        if share is None:
            edge = O._bin(O.chi_square(0.975, O.D))
        else:
            edge = np.sort(bins)[math.ceil(share * len(x)) - 1]
        near = x[bins <= edge]
        real = 0.975 if share is None else len(near) / len(x)
        center = near.mean(0)
        cov = near.T @ near / len(near) - np.outer(center, center)
        if real < 1:
            cov *= real / O._below(O.chi_square(real, O.D), O.D + 2)
        cov[np.diag_indices(O.D)] += np.maximum(np.array(O.SPREAD) ** 2 - np.diag(cov), 0) + 1e-9
        inverse = np.linalg.inv(cov)
    return center, inverse


def got(df):
    return collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in O.judge(df).collect())


def corpus(n=400):
    r = random.Random(3)
    words = ["w%s" % "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(900)]
    rows = []
    for i in range(n):
        t = "\n".join(" ".join(r.choice(words) for _ in range(r.randint(5, 20))) for _ in range(r.randint(2, 14)))
        if i % 11 == 0:
            t = " | ".join(t.split())
        if i % 17 == 0:
            t += ("\n" + t.split("\n")[0]) * r.randint(1, 9)
        rows.append((i, t, r.choice(("en", "de", None)) if i % 5 else "en", r.choice("ab")))
    return rows


def test_cases(spark):
    df = docs(spark)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]
    assert got(df) == brute(rows)
    assert O.judge(empty(spark)).count() == 0 and O.keep(empty(spark)).count() == 0


def test_brute(spark):
    rows = corpus()
    rows += rows[:3]
    want = brute(rows)
    assert got(docs(spark, rows).repartition(3)) == want
    bars = {i for i, t, _, _ in rows if " | " in t}
    assert not any(k[-1] for k in want if k[0] in bars) and sum(k[-1] for k in want) > 250


def test_keep(spark):
    rows = corpus()
    df = docs(spark, rows)
    kept = O.keep(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {k[0] for k in brute(rows) if k[-1]}


def test_small_pool_has_no_estimate(spark):
    rows = [(i, "word%d " % i * 0 + " ".join("t%d" % (i * j % 97) for j in range(70 + i)), "en", "s") for i in range(20)]
    assert all(r.distance is None for r in O.judge(docs(spark, rows)).collect())


def test_quality_labels(spark):
    """Held-out labels of the sf0.01 documents: clean ones stay, junk goes."""
    sf = "/root/testdata/sf0.01"
    judged = O.op1_quality_rules(spark, sf).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[(1, True)] and n.get((0, True), 0) <= 0.05 * n[(0, False)]
