"""Predecessors and validation of per-partition sequences; routing by key; twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import shard_index
from tidemark.operators import scan


def validate(rows: DataFrame, arrival: str, block: Column | None = None) -> DataFrame:
    """status (ok, negative, duplicate, regression), prev_offset and is_first, in order of arrival.

    Rejected rows don't move a partition's state, so the state is the running maximum of
    the offsets before that are 0 or more (a rejected offset never exceeds it).
    """
    real = F.when(F.col("offset") >= 0, F.col("offset"))
    rows = scan.prefix(rows, ["partition"], [arrival], scan.blocks(arrival) if block is None else block, _seen=("max_before", real))
    o, seen = F.col("offset"), F.col("_seen")
    status = F.when(o < 0, "negative").when(seen.isNull() | (o > seen), "ok").when(o == seen, "duplicate").otherwise("regression")
    ok = status == "ok"
    rows = rows.withColumn("status", status)
    return rows.withColumn("is_first", ok & seen.isNull()).withColumn("prev_offset", F.when(ok, F.coalesce(seen, o - 1))).drop("_seen")


def predecessors(m: DataFrame, block: int = scan.BLOCK, epoch: str | None = None) -> DataFrame:
    """prev_offset and is_first of an already ordered stream; a new epoch of a partition forgets what came before."""
    m = scan.prefix(m, ["partition", *[epoch] * (epoch is not None)], ["offset"], scan.blocks("offset", block), _p=("last_before", F.col("offset")))
    return m.withColumn("is_first", F.col("_p").isNull()).withColumn("prev_offset", F.coalesce("_p", F.col("offset") - 1)).drop("_p")


def sharded(m: DataFrame, shards: int) -> DataFrame:
    """The shard of each message's key, hashed row by row in the JVM: cheaper than a shuffle to hash each key once."""
    return m.withColumn("shard", shard_index("key", shards))


def lanes(m: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of a key together and in order, for functions that run over partitions."""
    n = [partitions] if partitions else []
    return m.repartition(*n, "key").sortWithinPartitions("key", "partition", "offset")


def latest_twins(rows: DataFrame) -> DataFrame:
    """One row of each (partition, offset): the one read last.  An aggregation, so copies shrink before the shuffle."""
    rest = [c for c in rows.columns if c not in ("partition", "offset")]
    best = F.max(F.struct("read_us", *[c for c in rest if c != "read_us"])).alias("_b")
    return rows.groupBy("partition", "offset").agg(best).select("partition", "offset", *[F.col(f"_b.{c}").alias(c) for c in rest])
