"""Contiguous watermarks, gap buffers and commits of one epoch, in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holes(m: DataFrame, done: Column) -> DataFrame:
    """A row for each partition: first_hole (null: none), max_offset_seen.  Partial minima, no window."""
    return m.groupBy("partition").agg(F.min(F.when(~done, F.col("offset"))).alias("first_hole"), F.max("offset").alias("max_offset_seen"))


def ready(m: DataFrame, done: Column) -> DataFrame:
    """partition, ready_offset (null: none), max_offset_seen, gap_depth: the completed prefix, and what waits behind it."""
    joined = m.select("partition", "offset", done.alias("_done")).join(holes(m, done), "partition")
    before = F.col("first_hole").isNull() | (F.col("offset") < F.col("first_hole"))
    return joined.groupBy("partition").agg(F.max(F.when(before, F.col("offset"))).alias("ready_offset"), F.first("max_offset_seen").alias("max_offset_seen"), F.count(F.when(F.col("_done") & ~before, 1)).alias("gap_depth"))


def gap_buffer(m: DataFrame, done: Column) -> DataFrame:
    """Completed rows that wait behind their partition's first hole."""
    return m.where(done).join(holes(m, done), "partition").where(F.col("offset") > F.col("first_hole"))


def tick_of(us: str, tick: int) -> Column:
    """The number of the first commit tick at or after a time."""
    return F.ceil(F.col(us) / F.lit(tick)).cast("long")


def commits(a: DataFrame, tick: int) -> DataFrame:
    """(partition, tick, offset) of each commit that moves: the highest offset whose prefix was complete by the tick."""
    return a.groupBy("partition", tick_of("watermark_us", tick).alias("tick")).agg(F.max("offset").alias("offset"))


def described(commits: DataFrame) -> DataFrame:
    """One line a tick, such as [p0:31930 p1:31738], by partition; a line is as long as a tick's partitions."""
    each = F.sort_array(F.collect_list(F.struct("partition", "offset")))
    parts = F.transform(each, lambda x: F.format_string("p%d:%d", x["partition"], x["offset"]))
    return commits.groupBy("tick").agg(F.concat(F.lit("["), F.array_join(parts, " "), F.lit("]")).alias("commits"))


def repaired(state: DataFrame, gap: DataFrame) -> DataFrame:
    """The successor that a stalled partition takes: the lowest g >= baseline with g = baseline or 0 <= prev(g) <= last.

    state: partition, baseline, last; gap: partition, offset, prev_offset.  Adds n_orphaned, the rows below it.
    """
    j = gap.join(state, "partition")
    proven = (F.col("offset") >= F.col("baseline")) & ((F.col("offset") == F.col("baseline")) | F.col("prev_offset").between(0, F.col("last")))
    found = j.groupBy("partition").agg(F.min(F.when(proven, F.col("offset"))).alias("successor")).where("successor is not null")
    return gap.join(found, "partition").groupBy("partition", "successor").agg(F.count(F.when(F.col("offset") < F.col("successor"), 1)).alias("n_orphaned"))
