"""Operator 9: near duplicates by MinHash with tensored banding, links confirmed on full sets.

Each document has two collections of T half keys, each of R minhashes; table (i, j) has
half key i of the first collection and j of the second as its key.  So T * T tables
of 2R minhashes come from 2TR minhashes in place of 2RTT.  A pair is found in some table
if and only if a half key of each collection agrees, so a pair of similarity s is missed
with probability 1 - (1 - (1 - s**R)**T)**2: 9e-6 at 0.85 for R = 3, T = 13.

Steps, none of which lists the pairs of a group:

1. Documents with equal shingle sets are one class, named by its smallest doc_id.
2. Half keys that only one class has can't be in a shared table key; the others of a
   class are combined to table keys, each with the class of the set's size and the next
   (sets that are similar enough differ by one size class at most).
3. Each table key's classes are compared with its smallest one, on full sets.
4. Links give components.  Where a table key still holds several components, the
   classes outside its largest component are compared with all others there, but for
   pairs that can't be similar enough: by the triangle inequality of the Jaccard distance
   (distances to the smallest class are known from step 3), or by the numbers of
   shingles that no other class of those keys has (they lie in no intersection).  So
   every pair with a common table key is linked, in one component already, or ruled
   out by a proof: nothing is capped.
5. The classes of table keys with more than ``WIDE`` classes, as around a text with very
   many loose copies, aren't paired: those that such keys connect are a bunch, a bunch
   is cut into blocks of about ``BLOCK`` texts and ``BYTES`` bytes at most, and for each pair of blocks one task
   counts common shingles by an index and returns one link for any two components.

Defined cases: documents without a word (null, empty or blank texts) have no shingle
and are linked with nothing; a null doc_id is linked with nothing and kept; rows with
the same doc_id are the same document; repeated rows have equal results; very long texts
are hashed in blocks of their own; an empty table gives no rows; other columns are ignored
by ``link`` and kept by ``keep``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _bytes as B
from tidemark.llm import _files
from tidemark.llm.components import components

T, R, PERCENT = 13, 3, 85
WIDE, BLOCK, BYTES = 16, 2048, 16 << 20
#: Shingles, and 100 for each document, of a task's share of the input (about 1.5 MB of text).
SHARE = 250_000
_random = np.random.RandomState(97)
_MULTIPLY = _random.randint(0, 1 << 62, 2 * T * R, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.randint(0, 1 << 62, 2 * T * R, dtype=np.int64).view(np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text and their owners, in order of both."""
    start, end, owner = B.words(data, offsets)
    hashes = B.spans(B.prefix(data, lower=True), start, end)
    found, at = B.triples(hashes, owner)
    many = np.bincount(owner, minlength=len(offsets) - 1)
    first = np.cumsum(many) - many
    one, two = np.flatnonzero(many == 1), np.flatnonzero(many == 2)
    found = np.concatenate([found, B.mix(hashes[first[one]] + np.uint64(0x1D8E4E27C47D124F)), B.mix(hashes[first[two]] * np.uint64(0xEB44ACCAB455D165) + B.mix(hashes[first[two] + 1] + np.uint64(77)))])
    owner = np.concatenate([owner[at], one, two])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], owner[new]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the set's fingerprint f1 and f2 (null if empty), and the half keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in B.blocks(batch.column("text")):
                n = len(offsets) - 1
                found, owner = shingles(data, offsets)
                many = np.bincount(owner, minlength=n)
                full = np.flatnonzero(many)
                starts = (np.cumsum(many) - many)[full]
                sums = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
                keys = np.zeros((n, 2 * T), np.uint64)
                if len(full):
                    sums[0][full] = np.add.reduceat(B.mix(found ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    sums[1][full] = np.add.reduceat(B.mix(found + np.uint64(0x14057B7EF767814F)), starts)
                    for k in range(2 * T):
                        key = np.full(len(full), k + 1, np.uint64)
                        for r in range(R):
                            least = np.minimum.reduceat(found * _MULTIPLY[k * R + r] + _ADD[k * R + r], starts)
                            key = B.mix(key * np.uint64(0x9FB21C651E98DF25) + least)
                        keys[full, k] = key
                none = many == 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 2 * T, pa.int32()), pa.array(keys.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), pa.array(many.astype(np.int64)), *(pa.array(s.view(np.int64), mask=none) for s in sums), lists], ["doc_id", "n_shingles", "f1", "f2", "keys"])

    return docs.select("doc_id", "text").mapInArrow(B.tidy(run), f"doc_id {kind}, n_shingles long, f1 long, f2 long, keys array<long>")


def tasks(signs: DataFrame) -> int:
    """How many tasks write a step's table at most: eight a core, or one for each ``SHARE`` of the input.  Small inputs dealt over many shuffle partitions needn't be as many files and runs of Python."""
    total = signs.agg(F.sum(F.col("n_shingles") + 100)).first()[0] or 0
    return max(8 * signs.sparkSession.sparkContext.defaultParallelism, total // SHARE)


def compared(pairs: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """pairs (a, b) with the sizes of intersection and union of their full sets, by ``most`` tasks at most."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = B.column(batch.column("text_a"))[1] + B.column(batch.column("text_b"))[1]
            first, n = 0, batch.num_rows
            while first < n:
                last = min(n, max(first + 1, int(np.searchsorted(size, size[first] + 2 * B.BLOCK, "right")) - 1))
                part = batch.slice(first, last - first)
                x, p = shingles(*B.column(part.column("text_a")))
                y, q = shingles(*B.column(part.column("text_b")))
                h, o = np.concatenate([x, y]), np.concatenate([p, q])
                order = np.lexsort((h, o))
                h, o = h[order], o[order]
                common = np.bincount(o[1:][(h[1:] == h[:-1]) & (o[1:] == o[:-1])], minlength=last - first)
                union = np.bincount(o, minlength=last - first) - common
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(common.astype(np.int64)), pa.array(union.astype(np.int64))], ["a", "b", "common", "whole"])
                first = last

    return both.coalesce(most).mapInArrow(B.tidy(run), f"a {kind}, b {kind}, common long, whole long")


def shingled(texts: DataFrame) -> DataFrame:
    """A row (doc_id, h) for each distinct shingle of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in B.blocks(batch.column("text")):
                found, owner = shingles(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at + owner)), pa.array(found.view(np.int64))], ["doc_id", "h"])

    return texts.mapInArrow(B.tidy(run), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, h long")


def blocks(wide: DataFrame, texts: DataFrame, percent: int, most: int) -> DataFrame:
    """Links (a, b) between components of each bunch.  wide: classes rep, with a label, by the least class of each wide table key that they have."""
    bunches = components(wide.select("least", "rep"))
    reps = wide.select("rep", "label").distinct().join(bunches.select(F.col("node").alias("rep"), F.col("label").alias("bunch")), "rep")
    reps = _files.stored(reps.coalesce(most), "bunches")
    size = texts.select(F.col("doc_id").alias("rep"), F.octet_length("text").alias("bytes"))
    many = reps.join(size, "rep").groupBy("bunch").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BYTES)).cast("int").alias("n"))
    placed = reps.join(many, "bunch").withColumn("k", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    # block k is first in the pairs (k, k) ... (k, n - 1) and second in (0, k) ... (k - 1, k)
    pairs = placed.select("rep", "label", "bunch", "k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")).select("rep", "label", "bunch", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"), "k")
    rows = pairs.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(key: tuple, group: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        group = group.combine_chunks()
        rep, label = group.column("rep").to_pylist(), group.column("label").to_pylist()
        numbers = {x: n for n, x in enumerate(dict.fromkeys(label))}
        label_of = np.array([numbers[x] for x in label])
        first = np.array(group.column("k").to_pylist()) == i
        parts = [(at, *shingles(data, offsets)) for at, data, offsets in B.blocks(group.column("text"))]
        found, owner = np.concatenate([h for _, h, _ in parts]), np.concatenate([at + o for at, _, o in parts])
        size = np.bincount(owner, minlength=len(rep))
        starts = np.cumsum(size) - size
        second = np.flatnonzero(~first if i != j else first)
        inside = np.isin(owner, second)
        order = np.argsort(found[inside], kind="stable")
        values, owners = found[inside][order], owner[inside][order]
        links: dict[tuple, tuple] = {}
        for x in np.flatnonzero(first):
            mine = found[starts[x] : starts[x] + size[x]]
            low, high = np.searchsorted(values, mine), np.searchsorted(values, mine, "right")
            common = np.bincount(owners[B.ragged(low, high - low)], minlength=len(rep))
            near = (common * 100 >= (size[x] + size - common) * percent) & (common > 0) & (label_of != label_of[x])
            for y in np.flatnonzero(near):
                links.setdefault(tuple(sorted((label_of[x], label_of[y]))), (rep[x], rep[y]))
        pairs = [sorted(p) for p in links.values()]
        return pa.table({"a": pa.array([p[0] for p in pairs], group.schema.field("rep").type), "b": pa.array([p[1] for p in pairs], group.schema.field("rep").type)})

    return rows.groupBy("bunch", "i", "j").applyInArrow(run, f"a {kind}, b {kind}")


def link(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    signs = _files.stored(signatures(docs), "signatures")
    most = tasks(signs)
    stored = lambda df, name: _files.stored(df.coalesce(most), name)
    real = signs.where("f1 is not null and doc_id is not null")
    classes = stored(real.groupBy("f1", "f2", "n_shingles").agg(F.min_by("keys", "doc_id").alias("keys"), F.min("doc_id").alias("rep")), "classes")
    # half keys that several classes have, and their combinations
    size_class = F.floor(F.log(F.col("n_shingles").cast("double")) / -math.log(percent / 100) + 1e-9).cast("int")
    halves = classes.select("rep", size_class.alias("c"), F.posexplode("keys").alias("k", "half"))
    shared = halves.groupBy("half").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("half")
    of = lambda first: F.collect_list(F.when((F.col("k") < T) if first else (F.col("k") >= T), F.col("half")))
    mine = halves.join(shared, "half").groupBy("rep", "c").agg(of(True).alias("one"), of(False).alias("two"))
    members = mine.select("rep", "c", F.explode("one").alias("one"), "two").select("rep", "c", "one", F.explode("two").alias("two"))
    members = members.select("rep", "one", "two", F.explode(F.array("c", F.col("c") + 1)).alias("c")).select(F.xxhash64("one", "two", "c").alias("key"), "rep")
    members = stored(members, "members")
    pivots = members.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("most")).where("pivot < most").select("key", "pivot")
    members = stored(members.join(pivots, "key"), "members")
    pairs = stored(members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = stored(docs.select("doc_id", "text").hint("merge").join(wanted.hint("merge"), "doc_id", "left_semi").distinct(), "texts")
    measured = stored(compared(pairs, texts, most), "measured")
    near = F.col("common") * 100 >= F.col("whole") * percent
    links = measured.where(near).select("a", "b")
    labels = stored(components(links), "labels")
    # table keys with several components
    label = F.coalesce("label", "rep")
    named = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "pivot", label.alias("label"))
    named = stored(named, "named")
    mixed = named.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l < m").select("key")
    distance = F.when(F.col("rep") == F.col("pivot"), 0.0).otherwise(1 - F.col("common") / F.col("whole"))
    far = measured.groupBy(F.col("a").alias("pivot"), F.col("b").alias("rep")).agg(F.max("common").alias("common"), F.max("whole").alias("whole"))
    inside = stored(named.join(mixed, "key").join(far, ["pivot", "rep"], "left").select("key", "rep", "pivot", "label", distance.alias("d")), "mixed")
    # shingles that only one class of these keys has
    pool = stored(classes.select("rep", "n_shingles").join(inside.select("rep").distinct(), "rep"), "pool")
    own = shingled(texts.join(pool.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")).groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep")).where("n = 1").groupBy("rep").agg(F.count("*").alias("u"))
    slack = 1 - percent / 100
    able = pool.join(own, "rep", "left").select("rep", F.col("n_shingles").alias("n"), F.coalesce("u", F.lit(0)).alias("u")).where(F.col("u") * 100 <= F.col("n") * (100 - percent))
    inside = stored(inside.join(able, "rep"), "able")
    sizes = inside.groupBy("key", "label").agg(F.count("*").alias("size"), F.min("rep").alias("least"))
    keys = sizes.groupBy("key").agg(F.max_by("label", F.struct("size", "label")).alias("largest"), F.count("*").alias("labels"), F.sum("size").alias("size"), F.min("least").alias("least")).where("labels > 1")
    keys = stored(keys, "keys")
    largest = keys.where(F.col("size") <= WIDE).select("key", "largest")
    cell = F.floor(F.col("d") / (slack + 1e-9))
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("rep", "label", "d", "n", "u")]
    minor = inside.join(largest, "key").where("label <> largest and rep <> pivot").select("key", *side("x"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    others = inside.where("rep <> pivot").select("key", *side("y"), cell.alias("cell"))
    common = F.least(F.col("x_n") - F.col("x_u"), F.col("y_n") - F.col("y_u"))
    possible = (F.col("x_label") != F.col("y_label")) & (F.abs(F.col("x_d") - F.col("y_d")) <= slack + 1e-9) & (common * 100 >= (F.col("x_n") + F.col("y_n") - common) * percent)
    crossing = minor.join(others, ["key", "cell"]).where(possible)
    crossing = crossing.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    crossing = stored(crossing, "crossing")
    more = compared(crossing, texts, most).where(near).select("a", "b")
    wide = inside.join(keys.where(F.col("size") > WIDE).select("key", "least"), "key").select("least", "rep", "label").distinct()
    wide = stored(wide, "wide")
    if not wide.isEmpty():
        more = more.union(blocks(wide, texts, percent, most))
    more = _files.stored(more, "more")
    if not more.isEmpty():
        labels = stored(components(labels.union(more)), "labels")
    # every document
    named = classes.select("f1", "f2", "n_shingles", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("f1", "f2", "n_shingles", label.alias("component_id"))
    linked = real.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    alone = signs.where("f1 is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents of which each component keeps one, with all their columns."""
    gone = link(docs, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM split
), classes AS (
  SELECT min(doc_id) AS rep, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
), rare AS (
  SELECT shingle, count(*) AS n FROM (SELECT unnest(s) AS shingle FROM classes) GROUP BY shingle
), ranked AS (
  SELECT rep, len(s) AS n, shingle, row_number() OVER (PARTITION BY rep ORDER BY rare.n, shingle) AS k
  FROM (SELECT rep, s, unnest(s) AS shingle FROM classes) JOIN rare USING (shingle)
), starts AS (
  SELECT rep, n, shingle FROM ranked WHERE k <= n - ceil(n * 0.85) + 1
), candidates AS (
  SELECT DISTINCT a.rep AS a, b.rep AS b FROM starts a JOIN starts b ON a.shingle = b.shingle AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
), links AS (
  SELECT a, b FROM candidates JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= 85 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT rep AS node, rep AS low FROM classes
  UNION
  SELECT ways.b, reach.low FROM reach JOIN ways ON ways.a = reach.node
), labels AS (SELECT node AS rep, min(low) AS label FROM reach GROUP BY node)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(label, sets.doc_id) AS component_id, coalesce(label, sets.doc_id) = sets.doc_id AS kept
FROM sets LEFT JOIN classes ON len(sets.s) > 0 AND list_sort(sets.s) = classes.s LEFT JOIN labels ON labels.rep = classes.rep
"""
