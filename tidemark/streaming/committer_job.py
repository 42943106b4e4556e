"""The committer on a stream of completions and control rows, with its state in Spark's state store.

A micro-batch is one ingest batch: its rows are applied in order of ``sequence`` and one
commit tick ends it.  Input rows: partition, sequence, event (complete, assign, revoke),
offset (of a completion, or the baseline of an assignment), prev_offset, is_first, read_us.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import sequence
from tidemark.streaming.committer import ORPHANED, Committer, Item

COMMITS = "partition int, committed long, n_completed long, n_orphaned long, gap_depth long, high long, orphans array<long>"


def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    c: Committer = pickle.loads(state.get[0]) if state.exists else Committer()
    rows = pd.concat(list(batches)).sort_values("sequence")
    done = 0
    for r in rows.itertuples(index=False):
        if r.event == "assign":
            c.assign(int(r.offset))
        elif r.event == "revoke":
            c.revoke()
        else:
            done += 1
            c.complete(Item(int(r.offset), int(r.prev_offset), bool(r.is_first), int(r.read_us)))
    committed = c.tick()
    orphans = [x.offset for x in c.take_finished() if x.traits & ORPHANED]
    state.update((pickle.dumps(c),))
    yield pd.DataFrame([{"partition": key[0], "committed": committed, "n_completed": done, "n_orphaned": len(orphans), "gap_depth": len(c.waiting), "high": c.high, "orphans": orphans}]).astype({"committed": "Int64", "high": "Int64"})


def commits(completions: DataFrame) -> DataFrame:
    """A streaming DataFrame of COMMITS rows, one for each partition and micro-batch that has rows of it."""
    return completions.groupBy("partition").applyInPandasWithState(step, COMMITS, "state binary", "append", "NoTimeout")


def orphan_rows(committed: DataFrame) -> DataFrame:
    """(partition, offset) of the records that can never be committed, from commits()."""
    return committed.select("partition", F.explode("orphans").alias("offset"))


def shared(spark: SparkSession) -> str:
    """A new folder for a job's files and checkpoint, below the one that all executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return f"{where.rstrip('/')}/committer-{uuid.uuid4().hex}"


def committed(spark: SparkSession, served: DataFrame, batches: int = 4) -> DataFrame:
    """Runs all completions of served messages, in order of finishing, and returns each partition's last commit."""
    root = shared(spark)
    rows = sequence.predecessors(served).select("partition", F.col("finish_us").alias("sequence"), F.lit("complete").alias("event"), "offset", "prev_offset", "is_first", "read_us")
    first = rows.where("is_first").select("partition", F.lit(-1).cast("long").alias("sequence"), F.lit("assign").alias("event"), "offset", "prev_offset", "is_first", "read_us")
    first.coalesce(1).write.parquet(f"{root}/in")
    rows.repartitionByRange(batches, "sequence").sortWithinPartitions("sequence").write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    q = commits(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(COMMITS).parquet(f"{root}/out")
    return out.groupBy("partition").agg(F.max("committed").alias("committed"), F.sum("n_completed").alias("n_completed"))
