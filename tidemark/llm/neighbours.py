"""Operator 6: approximate nearest neighbours by an inverted file with product-quantised residuals.

1. Equal vectors are one class; of a class only its ``nearest`` + 1 smallest ids are kept,
   since of rows with equal scores the smaller ids come first.  So a vector that a third
   of all rows share is one entry of the index.
2. Coarse centroids and codebooks are trained on the driver on at most ``SAMPLE`` classes
   (those with the smallest hashes); every class is indexed.  There are as many lists as
   the square root of the number of classes, ``LISTS`` at most; empty ones are dropped.
3. At most ``HELD`` further classes tune the search: for vectors among them, as many lists
   are probed as hold ``FOUND`` of their neighbours there, and codes may miss the inner
   product by the error that ``KEPT`` of those neighbours have.  A query goes on to further
   lists until these hold enough rows.
4. The query's twentieth best score among the held classes is a lower bound of its
   twentieth best score among all, so entries whose score by asymmetric distance tables is
   below that bound less the allowed error are dropped; the others are ranked by exact inner
   products in double precision.  The best held classes are candidates in any case.

Lists are put into shards of about ``PART`` entries, neighbouring lists together; a query
goes to each shard once, with the lists that it probes there.  A larger list is cut, and
the queries of a shard are cut into parts of about ``QUERIES``.

Defined cases: vectors that are null, of zero length, zero, or hold null or non-finite
components take no part, nor do those whose length isn't the most common one, nor rows
without vec_id; rows with equal vec_id are never each other's neighbours and count once,
with the best score; tables of fewer than 10 * ``nearest`` * 5 classes hold too few to tune
and are searched whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import _files

NEAREST, LISTS, CODES = 20, 4096, 256
SAMPLE, HELD, FOUND, KEPT = 32_768, 8_192, 0.97, 0.985
PART, QUERIES, CELLS = 32_768, 8_192, 1 << 21


def valid(rows: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part, each once."""
    element = rows.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding") if element in ("float", "double") else F.transform("embedding", lambda x: x.cast("double"))
    rows = rows.where("vec_id is not null and embedding is not null").select("vec_id", v.alias("embedding"))
    fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.where(fine).distinct()
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("embedding") == (common.n if common else 0))


def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """h, embedding and ids (the ``keep`` smallest) of each distinct vector."""
    hashed = rows.withColumn("h", F.xxhash64("embedding"))
    rank = F.row_number().over(W.partitionBy("h", "embedding").orderBy("vec_id"))
    first = hashed.withColumn("rank", rank).where(F.col("rank") <= keep)  # limited before the shuffle
    return first.groupBy("h", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


class Index:
    """Coarse centroids, codebooks and what tunes a search; made on the driver from a bounded sample."""

    def __init__(self, sample: np.ndarray, held: np.ndarray, lists: int, density: float, nearest: int = NEAREST, seed: int = 7) -> None:
        """density: held classes by all classes."""
        r = np.random.RandomState(seed)
        self.centroids = _means(sample, max(1, min(lists, len(sample))), r)
        residuals = sample - self.centroids[_nearest(sample, self.centroids)]
        d = sample.shape[1]
        self.parts = next(m for m in (16, 8, 4, 2, 1) if d % m == 0)
        self.books = np.stack([_means(x, min(CODES, len(x)), r) for x in np.split(residuals[: 64 * CODES], self.parts, axis=1)])
        self.held, self.nearest = held, nearest
        self.probes, self.error = len(self.centroids), math.inf
        if len(held) >= 10 * nearest:
            self._tune(max(1, round(nearest * density)))

    def _tune(self, nearest: int) -> None:
        """Probes and error for the held vectors' neighbours among themselves, as far away as a query's in the whole table."""
        q = self.held[:2000]
        scores = q @ self.held.T
        scores[np.arange(len(q)), np.arange(len(q))] = -math.inf
        found = np.argpartition(-scores, nearest - 1, axis=1)[:, :nearest]
        row, at = np.repeat(np.arange(len(q)), nearest), found.reshape(-1)
        lists, codes = self.encode(self.held)
        order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], 1)
        self.probes = int(np.quantile(rank[row, lists[at]], FOUND, method="higher")) + 1
        coded = self.centroids[lists] + np.concatenate([b[c] for b, c in zip(self.books, codes.T, strict=True)], axis=1)
        self.error = float(np.quantile(scores[row, at] - (q[row] * coded[at]).sum(1), KEPT, method="higher"))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = _nearest(x, self.centroids)
        cut = np.split(x - self.centroids[lists], self.parts, axis=1)
        return lists, np.stack([_nearest(c, b) for c, b in zip(cut, self.books, strict=True)], 1).astype(np.uint8)

    def scores(self, q: np.ndarray, lists: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with the coded vectors of a list, from tables."""
        out = np.repeat((q @ self.centroids[lists])[:, None].astype(np.float32), len(codes), 1)
        for part, book, code in zip(np.split(q, self.parts, axis=1), self.books, codes.T, strict=True):
            out += np.take((part @ book.T).astype(np.float32), code, axis=1)
        return out

    def seeds(self, q: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lower bounds of the scores of neighbours, places and scores of the best held classes); own: of each query, the held class that it is in, or -1."""
        if len(self.held) <= self.nearest:
            return np.full(len(q), -math.inf), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        rough = q @ self.held.T
        rough[np.flatnonzero(own >= 0), own[own >= 0]] = -math.inf
        best = np.argpartition(-rough, self.nearest - 1, axis=1)[:, : self.nearest]
        exact = (self.held[best] * q[:, None, :]).sum(2)
        return np.where((rough[np.arange(len(q))[:, None], best] > -math.inf).all(1), exact.min(1), -math.inf), best, exact

    def survivors(self, q: np.ndarray, least: np.ndarray, lists: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) pairs of one list that the codes don't rule out."""
        return np.nonzero(self.scores(q, lists, codes) >= (least - self.error - 1e-5)[:, None])


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(1) / 2
    return np.concatenate([np.argmax(x[k : k + 4096] @ centers.T - half, axis=1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _means(x: np.ndarray, k: int, r: np.random.RandomState, rounds: int = 10) -> np.ndarray:
    """At most k means of x; those that no vector is nearest to are dropped."""
    x = np.unique(x, axis=0)
    centers = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centers)
        many = np.bincount(near, minlength=len(centers))
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(many)
        centers = np.add.reduceat(x[order], (np.cumsum(many) - many)[full]) / many[full, None]
    return centers


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def _top(row: np.ndarray, score: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row; ties go to the smaller place."""
    order = np.lexsort((at, -score, row))
    row = row[order]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    order = order[rank < k]
    return row[rank < k], score[order], at[order]


class Shards:
    """Which shard each list (or part of a large one) is in."""

    def __init__(self, index: Index, rows: np.ndarray, entries: np.ndarray, wanted: int, part: int) -> None:
        """rows, entries: of each list.  wanted: number of shards, if they would be larger."""
        self.rows = rows
        part = max(1, min(part, -(-int(entries.sum()) // wanted)))
        groups = _means(index.centroids, max(1, int(len(index.centroids) ** 0.5)), np.random.RandomState(3), 5)
        order = np.argsort(_nearest(index.centroids, groups), kind="stable")
        self.pieces = np.maximum(1, -(-entries // part)).astype(np.int64)
        self.first = np.zeros(len(rows), np.int64)
        shard, size = 0, 0
        for k in order.tolist():
            if size and size + entries[k] > part:
                shard, size = shard + 1, 0
            self.first[k] = shard
            size += int(entries[k])
            if self.pieces[k] > 1:
                shard, size = shard + int(self.pieces[k]), 0
        self.many = shard + 1

    def probed(self, index: Index, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, shard, list) rows in order: the index's probes, and on until the lists hold enough rows."""
        order = np.argsort(-(q @ index.centroids.T), axis=1, kind="stable")
        enough = (np.cumsum(self.rows[order], axis=1) <= index.nearest).sum(1) + 1
        many = np.minimum(np.maximum(index.probes, enough), order.shape[1])
        row = np.repeat(np.arange(len(q)), many)
        lists = order[np.arange(order.shape[1])[None, :] < many[:, None]]
        pieces = self.pieces[lists]
        row, lists = np.repeat(row, pieces), np.repeat(lists, pieces)
        shard = self.first[lists] + np.arange(len(lists)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        order = np.lexsort((lists, shard, row))
        return row[order], shard[order], lists[order]


def scan(index: Index, x: np.ndarray, lists: np.ndarray, codes: np.ndarray, q: np.ndarray, least: np.ndarray, row: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, entry) of the best of one shard; (row, asked): the lists that the queries probe.  Entries are in order of lists."""
    found, size = [], 0
    by = np.argsort(asked, kind="stable")
    row, asked = row[by], asked[by]
    here, first = np.unique(lists, return_index=True)
    last = np.append(first[1:], len(lists))
    for k, a, b in zip(here.tolist(), first.tolist(), last.tolist(), strict=True):
        rows = row[np.searchsorted(asked, k) : np.searchsorted(asked, k, "right")]
        step = max(1, CELLS // (b - a))
        for s in range(0, len(rows), step):
            some = rows[s : s + step]
            i, j = index.survivors(q[some], least[some], k, codes[a:b])
            for c in range(0, len(i), CELLS // 8):
                r, e = some[i[c : c + CELLS // 8]], a + j[c : c + CELLS // 8]
                exact = (x[e] * q[r]).sum(1)
                found.append(_top(r, exact, e, index.nearest + 1))
                size += len(found[-1][0])
        if size > CELLS:
            found = [_top(*(np.concatenate(z) for z in zip(*found, strict=True)), index.nearest + 1)]
            size = 0
    if not found:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    return _top(*(np.concatenate(z) for z in zip(*found, strict=True)), index.nearest + 1)


def trained(classes: DataFrame, n: int, nearest: int) -> tuple[Index, pa.Array]:
    """The index, and the ids of its held classes, from SAMPLE + HELD classes at most."""
    share = min(1.0, 1.2 * (SAMPLE + HELD) / n)  # only about as many as are needed are sorted
    some = classes if share == 1 else classes.where(F.pmod("h", F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    sample = some.orderBy(F.xxhash64("h"), "h", "embedding").limit(SAMPLE + HELD).select("embedding", "ids").toArrow().combine_chunks()
    x = _matrix(sample.column("embedding").combine_chunks())
    held = min(HELD, len(x) // 5)
    index = Index(x[held:], x[:held], min(LISTS, max(1, math.isqrt(n))), held / n, nearest)
    return index, sample.column("ids").combine_chunks().slice(0, held)


def search(rows: DataFrame, queries, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest found.  queries: a condition on vec_id."""
    spark, kind = rows.sparkSession, rows.schema["vec_id"].dataType.simpleString()
    rows = _files.stored(valid(rows), "vectors")
    classes = _files.stored(classes_of(rows, nearest + 1), "classes")
    n, vector = classes.count(), rows.schema["embedding"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    index, held_ids = trained(classes, n, nearest)
    shared = spark.sparkContext.broadcast(index)  # LISTS centroids, CODES codes a part and HELD vectors at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, codes = shared.value.encode(_matrix(batch.column("embedding")))
            m = codes.shape[1]
            packed = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer((np.arange(len(codes) + 1) * m).astype(np.int32).tobytes()), pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "ids", "embedding")), pa.array(lists.astype(np.int32)), packed], ["h", "ids", "embedding", "list", "codes"])

    indexed = _files.stored(classes.select("h", "ids", "embedding").mapInArrow(place, f"h long, ids array<{kind}>, embedding {vector}, list int, codes binary"), "index")
    sizes = np.zeros((2, len(index.centroids)), np.int64)
    for r in indexed.groupBy("list").agg(F.sum(F.size("ids")).alias("rows"), F.count("*").alias("entries")).collect():  # LISTS rows at most
        sizes[:, r.list] = r.rows, r.entries
    shards = Shards(index, *sizes, 2 * spark.sparkContext.defaultParallelism, PART)
    dealt = spark.sparkContext.broadcast((shards, held_ids))
    seed = f"array<struct<vec_id:{kind},score:double>>"

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, (shards, held_ids) = shared.value, dealt.value
        many, flat = held_ids.value_lengths().to_numpy(), held_ids.flatten()
        ends = np.cumsum(many)
        class_of = {x: k for k, x in reversed(list(enumerate(map(bytes, index.held))))}
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                q = _matrix(batch.column("embedding"))
                own = np.array([class_of.get(bytes(x), -1) for x in q], np.int64)
                least, best, exact = index.seeds(q, own)
                row, shard, lists = shards.probed(index, q)
                head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])))
                at, k = np.concatenate([row[head], np.arange(len(q))]), len(head)
                cut = np.concatenate([head, np.full(len(q) + 1, len(row))])
                # the best held classes, with all their ids, in a row of its own (shard -1)
                held, times = best.reshape(-1), many[best.reshape(-1)]
                members = pa.array(np.repeat(ends[held] - times, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
                structs = pa.StructArray.from_arrays([flat.take(members), pa.array(np.repeat(exact.reshape(-1), times))], ["vec_id", "score"])
                per = times.reshape(best.shape).sum(1)
                seeds = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(k, np.int64), [0], np.cumsum(per)]), pa.int32()), structs)
                columns = [batch.column("vec_id").take(pa.array(at)), batch.column("embedding").take(pa.array(at)), pa.array(least[at]), pa.array(np.concatenate([shard[head], np.full(len(q), -1)]).astype(np.int32)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(lists.astype(np.int32))), seeds]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "query", "least", "shard", "lists", "seeds"])

    asked = rows.where(queries).select("vec_id", "embedding").mapInArrow(probe, f"query_id {kind}, query {vector}, least double, shard int, lists array<int>, seeds {seed}")
    asked = _files.stored(asked, "asked")
    many = asked.where("shard < 0").count()
    parts = max(1, -(-many // QUERIES))
    first = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(zip(shards.first, shards.pieces, strict=True))], "list int, first int, pieces int").coalesce(1)
    left = indexed.join(F.broadcast(first), "list")  # LISTS rows at most
    left = left.withColumn("shard", (F.col("first") + F.pmod("h", F.col("pieces"))).cast("int")).drop("first", "pieces")
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = asked.where("shard >= 0").drop("seeds").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))

    def best(key: tuple, base: pa.Table, ask: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", ask.schema.field("query_id").type), ("ids", base.schema.field("ids").type), ("score", pa.float64())])
        if not base.num_rows or not ask.num_rows:
            return out.empty_table()
        ids = base.column("ids").combine_chunks()
        starts = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])[:-1]
        base = base.append_column("least_id", ids.flatten().take(pa.array(starts))).sort_by([("list", "ascending"), ("least_id", "ascending")]).combine_chunks()
        ask = ask.combine_chunks()
        x, q = (_matrix(t.column(c).combine_chunks()) for t, c in ((base, "embedding"), (ask, "query")))
        codes = np.frombuffer(b"".join(base.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
        lists = ask.column("lists").combine_chunks()
        row = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
        found = scan(shared.value, x, base.column("list").to_numpy(), codes, q, ask.column("least").to_numpy(), row, lists.flatten().to_numpy())
        return pa.table([ask.column("query_id").take(pa.array(found[0])), base.column("ids").take(pa.array(found[2])), pa.array(found[1])], schema=out)

    found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(best, f"query_id {kind}, ids array<{kind}>, score double")
    found = found.select("query_id", F.explode("ids").alias("vec_id"), "score")
    found = found.union(asked.where("shard < 0").select("query_id", F.explode("seeds").alias("s")).select("query_id", "s.vec_id", "s.score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 20 = 0")
