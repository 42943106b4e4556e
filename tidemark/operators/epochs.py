"""Assignment epochs: ownership and the validity of completions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000_000


def control(m: DataFrame) -> DataFrame:
    """Assigned intervals [from_us, to_us) of each partition: partition p is revoked on days with (day + p) % 7 = 0."""
    p = F.col("partition")
    span = m.groupBy("partition").agg(F.floor((F.floor(F.min("read_us") / DAY) + F.first("partition")) / 7).cast("long").alias("a"), F.floor(F.max(F.floor(F.col("read_us") / DAY) + p) / 7).cast("long").alias("b"))
    weeks = span.select("partition", F.explode(F.sequence(F.col("a"), F.col("b") + 60)).alias("epoch"))
    return weeks.select("partition", "epoch", ((F.col("epoch") * 7 + 1 - p) * DAY).alias("from_us"), ((F.col("epoch") * 7 + 7 - p) * DAY).alias("to_us"))


def owned(rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """Rows read while their partition was assigned.  The interval join has an equality, so it is no cross join."""
    e = assigned.select(F.col("partition").alias("_p"), "from_us", "to_us")
    inside = (F.col("partition") == F.col("_p")) & (F.col("read_us") >= F.col("from_us")) & (F.col("read_us") < F.col("to_us"))
    return rows.join(e, inside, "left_semi")


def marked(completions: DataFrame, assigned: DataFrame) -> DataFrame:
    """Completions with ``orphaned``: not finished in the epoch in which they were read."""
    e = assigned.select(F.col("partition").alias("_p"), "from_us", "to_us")
    inside = (F.col("partition") == F.col("_p")) & (F.col("read_us") >= F.col("from_us")) & (F.col("read_us") < F.col("to_us"))
    return completions.join(e, inside, "left").withColumn("orphaned", ~F.coalesce(F.col("finish_us") < F.col("to_us"), F.lit(False))).drop("_p", "from_us", "to_us")
