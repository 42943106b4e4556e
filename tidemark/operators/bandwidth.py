"""Bandwidth packets, flush batches, and throughput figures of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scan

FLUSH_US, BUFFER = 60_000_000, 50


def received(rows: DataFrame, payload: str, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("received_messages"), F.sum(F.octet_length(payload)).alias("received_bytes"))


def flushes(packets: DataFrame, tick: str, order: str, most: int) -> DataFrame:
    """Batches of a buffer that is flushed at ``most`` packets and at each tick: (tick, flush, n_packets, first)."""
    numbered = scan.prefix(packets, [tick], [order], scan.blocks(order), _k=("sum_before", F.lit(1)))
    batches = numbered.withColumn("flush", F.floor(F.col("_k") / most).cast("long")).groupBy(tick, "flush")
    return batches.agg(F.count("*").alias("n_packets"), F.min(order).alias("first"))


def aggregated(packets: DataFrame, at_us: str, order: str, failed: Column, every_us: int = FLUSH_US, most: int = BUFFER) -> DataFrame:
    """Flushes every minute or at 50 packets, by hour: n_flushes, and the packets flushed and dropped; failed: of a batch whose sink fails."""
    batches = flushes(packets.withColumn("tick", F.floor(F.col(at_us) / every_us).cast("long")), "tick", order, most)
    hour = F.floor(F.col("tick") * every_us / 3_600_000_000).cast("long").alias("hour")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n_packets"))), F.lit(0))
    return batches.groupBy(hour).agg(F.count("*").alias("n_flushes"), total(~failed).alias("flushed"), total(failed).alias("dropped"))


def packets(rows: DataFrame, payload: str, tick: str, **labels: str) -> DataFrame:
    """One packet a tick: partitions as a list of structs, and constant labels (topic, consumer_group, ...)."""
    each = received(rows, payload, tick, "partition")
    listed = F.sort_array(F.collect_list(F.struct("partition", "received_bytes", "received_messages")))
    return each.groupBy(tick).agg(listed.alias("partitions")).withColumns({k: F.lit(v) for k, v in labels.items()})


def efficiency(served: DataFrame) -> DataFrame:
    """Actual and theoretical throughput of served messages, and their ratio in percent (-1 if nothing takes time)."""
    keys = served.groupBy("key").agg(F.min("start_us").alias("a"), F.max("finish_us").alias("b"), F.count("*").alias("n"), F.sum("process_us").alias("busy"), F.sum(F.col("finish_us") - F.col("read_us")).alias("e2e"))
    x = keys.agg(F.sum("n").alias("n"), (F.max("b") - F.min("a")).alias("span_us"), F.count("*").alias("keys"), F.sum("busy").alias("busy"), F.sum("e2e").alias("e2e"))
    actual = F.col("n") * F.lit(1e6) / F.col("span_us")
    theoretical = F.col("keys") * F.lit(1e6) * F.col("n") / F.col("busy")
    percent = F.when(F.col("busy") == 0, -1.0).otherwise(F.round(F.lit(100.0) * actual / theoretical, 6))
    return x.select("n", "span_us", F.round(actual, 6).alias("actual_tps"), F.round(theoretical, 6).alias("theoretical_tps"), percent.alias("efficiency_pct"), F.expr("busy div n").alias("avg_process_us"), F.expr("e2e div n").alias("avg_e2e_us"))


def with_efficiency(runs: DataFrame) -> DataFrame:
    """Runs (latency_ms, keys, tps) with eff, in percent of keys / latency; -1 without latency."""
    return runs.withColumn("eff", F.when(F.col("latency_ms") > 0, F.lit(100.0) * F.col("tps") / (F.col("keys") * F.lit(1000.0) / F.col("latency_ms"))).otherwise(-1.0))
