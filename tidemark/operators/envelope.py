"""Envelopes: the columns by which any payload takes part in a stream, and their guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extract(df: DataFrame, partition: Column | str, offset: Column | str, key: Column | str, context: dict[str, Column] | None = None) -> DataFrame:
    """partition, offset, key and ctx (a map of strings) of each row, with all its columns as payload."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    payload = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    ctx = F.create_map(*[x for k, v in (context or {}).items() for x in (F.lit(k), v.cast("string"))]) if context else F.expr("cast(map() as map<string,string>)")
    return df.select(column(partition).cast("int").alias("partition"), column(offset).cast("long").alias("offset"), column(key).cast("string").alias("key"), ctx.alias("ctx"), payload.alias("payload"))


def enrich(enveloped: DataFrame, **context: Column) -> DataFrame:
    """More context, after extraction; of equal names the new value holds."""
    more = F.create_map(*[x for k, v in context.items() for x in (F.lit(k), v.cast("string"))])
    return enveloped.withColumn("ctx", F.map_concat(F.map_filter("ctx", lambda k, v: ~k.isin(*context)), more))


def guard(events: DataFrame, topic: str) -> DataFrame:
    """Fails the query at an event of another topic; an empty or null topic is unspecified and passes."""
    fine = F.col("topic").isNull() | F.col("topic").isin("", topic)
    wrong = F.raise_error(F.concat(F.lit("foreign topic: "), F.coalesce("topic", F.lit("")))).cast("boolean")
    return events.where(F.when(fine, F.lit(True)).otherwise(wrong))


def stamped(enveloped: DataFrame) -> DataFrame:
    """read_us, the time at which the batch was read, where the source gives none."""
    return enveloped if "read_us" in enveloped.columns else enveloped.withColumn("read_us", F.unix_micros(F.current_timestamp()))


def metrics(completions: DataFrame) -> DataFrame:
    """Metrics rows: by rule without key, context and payload; the user's traits are added to the engine's."""
    own = F.col("custom_traits") if "custom_traits" in completions.columns else F.lit(0)
    keep = [c for c in completions.columns if c not in ("key", "ctx", "payload", "custom_traits", "traits", "error")]
    return completions.select(*keep, F.col("traits").bitwiseOR(F.coalesce(own.cast("long"), F.lit(0))).alias("traits"))
