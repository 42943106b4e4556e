"""Bucket statistics, rolling windows, snapshots and admission counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scan


def buckets(rows: DataFrame, bucket: Column, *keys: str) -> DataFrame:
    """Statistics by bucket (and keys) of rows with process_us, e2e_us and dead_letter."""
    return rows.groupBy(*keys, bucket.alias("bucket")).agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("dead_letter"), 1)).alias("n_dead_letters"),
        F.sum("process_us").alias("sum_process_us"),
        F.max("process_us").alias("max_process_us"),
        F.sum("e2e_us").alias("sum_e2e_us"),
        F.max("e2e_us").alias("max_e2e_us"),
        F.min("e2e_us").alias("min_e2e_us"),
    )


def window(stats: DataFrame, width: int, *keys: str) -> DataFrame:
    """The last ``width`` buckets of each key, up to its newest one, with zeros for empty buckets."""
    newest = stats.groupBy(*keys).agg(F.max("bucket").alias("newest"))
    slots = newest.select(*keys, F.explode(F.sequence(F.col("newest") - (width - 1), F.col("newest"))).alias("bucket"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n", "n_dead_letters", "sum_process_us", "sum_e2e_us")}
    return slots.join(stats, [*keys, "bucket"], "left").withColumns(zero)


def rollup(stats: DataFrame, width: int, *keys: str) -> DataFrame:
    """One row a key over its last buckets, with integer averages where anything was counted, and the total ever."""
    w = window(stats, width, *keys).groupBy(*keys).agg(F.max("bucket").alias("newest"), F.sum("n").alias("n"), F.sum("n_dead_letters").alias("n_dead_letters"), F.sum("sum_process_us").alias("sum_process_us"), F.sum("sum_e2e_us").alias("sum_e2e_us"), F.max("max_e2e_us").alias("max_e2e_us"), F.min("min_e2e_us").alias("min_e2e_us"))
    total = stats.groupBy(*keys).agg(F.sum("n").alias("total"))
    average = lambda c: F.when(F.col("n") > 0, F.expr(f"{c} div n"))
    return w.join(total, list(keys)).withColumn("avg_process_us", average("sum_process_us")).withColumn("avg_e2e_us", average("sum_e2e_us"))


def listed(stats: DataFrame, width: int, bucket_us: int, *keys: str) -> DataFrame:
    """The last ``width`` buckets of each key, newest first (position 0), with the times they run from and to (whole milliseconds)."""
    newest = stats.groupBy(*keys).agg(F.max("bucket").alias("_newest"))
    at = F.col("bucket") * bucket_us
    rows = window(stats, width, *keys).join(newest, list(keys))
    return rows.select(*keys, (F.col("_newest") - F.col("bucket")).cast("long").alias("position"), at.alias("from_us"), (at + (bucket_us - 1000)).alias("to_us"), F.col("n").alias("processed"), F.col("n_dead_letters").alias("dead_letters"))


def busy_periods(served: DataFrame) -> DataFrame:
    """(key, from_us, to_us) of the times in which a key's lane isn't empty."""
    s = scan.prefix(served, ["key"], ["offset"], scan.blocks("offset"), _run=("sum", F.when(F.col("start_us") == F.col("read_us"), 1).otherwise(0)))
    return s.groupBy("key", "_run").agg(F.min("start_us").alias("from_us"), F.max("finish_us").alias("to_us")).drop("_run")


def sweep(periods: DataFrame, block: int) -> DataFrame:
    """(at_us, active): the number of open periods after each change, by a running sum over blocks of time; ends go before starts."""
    ends = F.array(F.struct(F.col("from_us").alias("at_us"), F.lit(1).alias("step")), F.struct(F.col("to_us").alias("at_us"), F.lit(-1).alias("step")))
    changes = periods.select(F.inline(ends)).groupBy("at_us").agg(F.sum("step").alias("step")).withColumn("_all", F.lit(0))
    return scan.prefix(changes, ["_all"], ["at_us"], scan.blocks("at_us", block), active=("sum", F.col("step"))).select("at_us", "active")


def queue_depths(served: DataFrame, block: int = 86_400_000_000) -> DataFrame:
    """Messages of the same key that wait (not yet started) when a message arrives, without itself."""
    times = F.array(F.struct(F.col("read_us").alias("t"), F.lit(1).alias("kind")), F.struct(F.col("start_us").alias("t"), F.lit(0).alias("kind")))
    both = served.select("key", "offset", "partition", F.inline(times))
    both = scan.prefix(both, ["key"], ["t", "kind", "offset"], scan.blocks("t", block), _started=("sum", F.lit(1) - F.col("kind")), _arrived=("sum_before", F.col("kind")))
    return both.where("kind = 1").select("partition", "offset", "key", (F.col("_arrived") - F.least("_started", "_arrived")).alias("queue_depth"))


def gcra(m: DataFrame, interval: int, burst: int, block: int = scan.BLOCK) -> DataFrame:
    """release_us of a token bucket (full at first, one token an interval) for each partition's messages in order."""
    place = scan.blocks("offset", block)
    m = scan.prefix(m, ["partition"], ["offset"], place, _i=("sum_before", F.lit(1)))
    m = scan.prefix(m, ["partition"], ["offset"], place, _m=("max_before", F.col("read_us") - F.col("_i") * interval))
    before = F.col("_m") + F.col("_i") * interval  # the theoretical arrival time after the messages before
    return m.withColumn("release_us", F.greatest("read_us", before - (burst - 1) * interval)).drop("_i", "_m")
