"""Message streams over the driver's tables, and the single place of their constants.

``events`` is a stream: partition = user_id % 12, offset = event_id (gapped inside a
partition), key = user_id, read time = ts.  Times are whole microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import scan

PARTITIONS, SHARDS = 12, 16
HOUR, DAY = 3_600_000_000, 86_400_000_000
TICK = 6 * HOUR
TRAITS = {"used_overflow": 1, "process_panic": 2, "process_error": 4, "dead_letter": 8, "first_after_rebalance": 16, "commit_buffered": 32, "orphaned": 64, "duplicate": 128}


def micros(column: str):
    """Microseconds since 1970 of a timestamp without zone; no session zone takes part."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    fails = F.col("event_type") == "error"
    return e.select(
        (F.col("user_id") % PARTITIONS).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("user_id").cast("string").alias("key"),
        micros("ts").alias("read_us"),
        (F.round(F.col("value") * 100).cast("long") * 100000).alias("process_us"),
        fails.alias("fails"),
        (fails & (F.col("event_id") % 2 == 0)).alias("panics"),
        (fails & (F.col("event_id") % 997 == 0)).alias("dl_fails"),
        "event_type",
        "props",
    )


def served(m: DataFrame, block: int = scan.BLOCK) -> DataFrame:
    """Messages with start_us and finish_us: each key a queue of its own, served in order.

    finish = C + max over earlier (read - C before), C the running sum of service times.
    """
    m = scan.queued(m, ["key"], ["offset"], scan.blocks("offset", block), F.col("read_us"), F.col("process_us"))
    return m.withColumnRenamed("_finish", "finish_us").withColumn("start_us", F.col("finish_us") - F.col("process_us"))


def advanced(m: DataFrame, block: int = scan.BLOCK) -> DataFrame:
    """Served messages with watermark_us: when all of the partition up to the offset have finished."""
    return scan.prefix(served(m, block), ["partition"], ["offset"], scan.blocks("offset", block), watermark_us=("max", F.col("finish_us")))
