"""Connected components of a table of links, by alternating large and small stars.

Each round is two aggregations by node (partial minima before the shuffle) with joins
that Spark can split at hot nodes; rounds are written to the shared folder.  A table of
at most ``FEW`` links needs no rounds: one task unites them, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _files

#: Links that one task unites (about 60 MB of its memory); more are dealt out to all tasks.
FEW = 1 << 18


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node that it reaches) of every node in links (two columns)."""
    u, v = links.columns
    edges = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v")
    edges = _files.stored(edges, "edges")
    if edges.count() <= FEW:
        kind = edges.schema["u"].dataType.simpleString()
        return edges.coalesce(1).mapInArrow(_united, f"node {kind}, label {kind}")
    raw, edges = edges, _files.stored(edges.distinct(), "edges")
    _files.remove(edges.sparkSession, raw.stored_at)
    while not _stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = _files.stored(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        small = _files.stored(small, "edges")
        _files.remove(edges.sparkSession, edges.stored_at, large.stored_at)
        edges = small
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and label of one task's links; the smaller root stays a root, so each root is the smallest node of its component."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), kind), pa.array([root(x) for x in list(parent)], kind)], ["node", "label"])


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either a center or linked to one center only."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("center")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("center").alias("center")).where("leaf + center > 1").isEmpty()
