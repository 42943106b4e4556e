import collections
import random
import re

import pytest
from cases import docs, empty
from pyspark.sql import functions as F

from tidemark.llm import _files, components, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w)} if 0 < len(w) < 3 else set(zip(w, w[1:], w[2:]))


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and i is not None and j is not None and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return collections.Counter((i, len(x), root(i), i is None or root(i) == i) for i, x in sets)


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert collections.Counter(map(tuple, minhash.link(df).select("doc_id", "n_shingles", "component_id", "kept").collect())) == brute(rows)


def test_cases(spark):
    check(docs(spark))
    assert minhash.link(empty(spark)).count() == 0


def test_groups_and_chains(spark):
    r = random.Random(5)
    vocabulary = ["w%d" % k for k in range(3000)]
    rows, n = [], 0
    for group in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice((8, 30, 120, 400)))]
        chain = list(base)
        for copy in range(r.choice((1, 2, 5, 12))):
            words = list(chain if group % 2 else base)
            for _ in range(r.randint(0, max(1, len(words) // 40))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            chain = words
            rows.append((n, r.choice((" ", "\n", "  ")).join(words).upper() if copy % 3 == 1 else " ".join(words), "en", "s"))
            n += 1
    r.shuffle(rows)
    check(docs(spark, rows + rows[:5]))


def test_ring_between_components(spark):
    """Links that no smallest class of a table key has: found by the pass over mixed keys."""
    words = ["a%d" % k for k in range(300)]
    rows = []
    for i in range(40):
        w = list(words)
        for k in range(0, 6):
            w[(i * 7 + k * 41) % 300] = "x%d_%d" % (i, k)
        rows.append((i, " ".join(w), "en", "s"))
    check(docs(spark, rows))


def test_keep(spark):
    df = docs(spark)
    kept = minhash.keep(df)
    assert kept.columns == df.columns
    want = {i for (i, _, _, k) in brute([(r.doc_id, r.text) for r in df.collect()]) if k}
    assert {r.doc_id for r in kept.collect()} == want


@pytest.mark.parametrize("n", [1, 300])
def test_components(spark, n):
    path = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1000, 1000 + n).select(F.col("id").alias("a"), F.lit(5000).cast("long").alias("b"))
    got = {r.node: r.label for r in components.components(path.union(star).union(path)).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, **{i: 1000 for i in range(1000, 1000 + n)}, 5000: 1000}
    assert components.components(path.where("a < 0")).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert collections.Counter(map(tuple, minhash.op9_minhash(spark, sf).collect())) == brute(rows)


def test_blocks_of_long_texts(spark, monkeypatch):
    """Wide keys whose texts are long: blocks are bounded in bytes, and no link is lost."""
    r = random.Random(21)
    for name, value in (("WIDE", 2), ("BLOCK", 4), ("BYTES", 3000)):
        monkeypatch.setattr(minhash, name, value)
    monkeypatch.setattr(minhash.B, "BLOCK", 2000)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(40):
        own = list(base)
        for _ in range(r.choice((1, 2, 3, 5))):
            own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(own) * (1 if i else 3), "en", "s"))
    check(docs(spark, rows))


def test_few_links_need_no_rounds(spark):
    """Small tables of links are united in one task: no shuffles, and no table a round."""
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    made = len(_files.made)
    found = components.components(path)
    assert len(_files.made) == made + 1
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.node: r.label for r in found.collect()} == dict.fromkeys(range(301), 0)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_rounds_and_one_task_agree(spark, monkeypatch, kind):
    """Random links, repeated ones, loops and nulls: the same components on both sides of FEW, whose boundary is inclusive."""
    r = random.Random(9)
    rows = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(i, 7) for i in range(500, 560)]
    rows += rows[:20] + [(3, 3), (None, 5), (5, None), (None, None)]
    links = spark.createDataFrame(rows, "a long, b long").select(F.col("a").cast(kind), F.col("b").cast(kind))
    real = links.where("a <> b").count()
    got = []
    for few in (real, real - 1):
        monkeypatch.setattr(components, "FEW", few)
        made = len(_files.made)
        got.append(sorted(map(tuple, components.components(links).collect())))
        assert (len(_files.made) == made + 1) == (few == real)
    assert got[0] == got[1] and len(got[0]) == len(set(got[0]))
    assert (got[0][0][0] == min(x for x, _ in got[0])) and len({y for _, y in got[0]}) > 5


def test_links_by_rounds(spark, monkeypatch):
    """The whole operator with every table of links dealt out."""
    monkeypatch.setattr(components, "FEW", 0)
    monkeypatch.setattr(minhash, "WIDE", 2)
    test_ring_between_components(spark)


def test_small_partitions_are_few_files(spark):
    """Many small shuffle partitions: tables between steps are written by a bounded number of tasks, and no link is lost."""
    r = random.Random(33)
    rows = []
    for i in range(150):
        words = [f"w{r.randrange(10**6)}" for _ in range(60)]
        rows.append((2 * i, " ".join(words), "en", "s"))
        words[r.randrange(60)] = "other"
        rows.append((2 * i + 1, " ".join(words), "en", "s"))
    held = {"spark.sql.shuffle.partitions": "80", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    made = len(_files.made)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        most = 8 * spark.sparkContext.defaultParallelism
        assert most < 80
        check(docs(spark, rows))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = {p: len(spark.read.parquet(p).inputFiles()) for p in _files.made[made:]}
    names = {"classes", "members", "pairs", "texts", "measured"}
    steps = {p: n for p, n in files.items() if p.rsplit("/", 1)[1].split("-")[0] in names}
    assert len(steps) == 6 and max(steps.values()) <= most


def test_tasks_grow_with_the_input(spark):
    least = 8 * spark.sparkContext.defaultParallelism
    signs = lambda n, size: spark.range(n).select(F.lit(size).cast("long").alias("n_shingles"))
    assert minhash.tasks(signs(0, 0)) == minhash.tasks(signs(1000, 50)) == least
    assert minhash.tasks(signs(1000, minhash.SHARE)) >= 1000
    assert minhash.tasks(signs(1_000_000, 0)) == 100_000_000 // minhash.SHARE
