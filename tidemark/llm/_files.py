"""Tables and folders between steps, in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Only a local session without that setting, as in tests, gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = os.path.join(tempfile.gettempdir(), f"tidemark-{os.getuid()}")
    os.makedirs(where, exist_ok=True)
    return f"file://{where}"


#: Paths given out by this driver, in order.
made: list[str] = []


def place(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    made.append(f"{shared(spark)}/{name}-{uuid.uuid4().hex}")
    return made[-1]


def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """df stored; the tables made for it (from number ``since`` of ``made`` on) are deleted then."""
    out = stored(df, name)
    remove(df.sparkSession, *(p for p in made[since:] if p != out.stored_at))
    made[since:] = [out.stored_at]
    return out


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage ends here and it's computed once."""
    spark, path = df.sparkSession, place(df.sparkSession, name)
    schema = df.schema
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of this run that no later step reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
