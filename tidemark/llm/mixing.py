"""Operator 7: mixing sources to target weights, with DataFrame operations only.

Words are counted per source (partial sums before the shuffle).  The targets are a
water level: with every source at min(cap, level * weight) the shares sum to the
whole, which is what resharing any excess by weight ends in.  A source's repetition
rate is its target over its size; a document is taken floor(rate) times, and once more
if a hash of its doc_id and the seed, as a number in [0, 1), is below the fraction.

Defined cases: null text has size 0; a null source is a source of its own, last; equal
doc_ids draw alike; a source of size 0 has target 0, and its documents are taken once
(they hold no words); an empty table gives no rows.  Texts of any length are counted whole.
``copies`` keeps other columns whatever their names; ``mix`` adds mix_size, mix_source_size,
mix_target and mix_copies in place of columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import _files

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"
#: Sources of at most this many rows are broadcast (about 100 bytes each); more are joined by a shuffle that splits skewed sources.
BROADCAST_ROWS = 20_000


def size_of(text: Column | str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """A row for each source: mix_source, source_size, target."""
    sums = docs.groupBy(F.col("source").alias("mix_source")).agg(F.sum(size_of()).alias("source_size"))
    by_name = W.orderBy(F.col("mix_source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    named = sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * cap)
    # by the level at which each source is full; all before it are full when it's looked at
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("mix_source").asc_nulls_last())
    before, whole = by_level.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = named.withColumn("level", level)
    final = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"]
    return levels.select("mix_source", "source_size", F.coalesce(F.least("cap", final * F.col("weight")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies (how often the mix takes a document)."""
    sources = _files.stored(targets(docs, weights, share, cap).coalesce(1), "sources")
    small = sources.count() <= BROADCAST_ROWS
    sources = sources.select("mix_source", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    joined = docs.withColumn("mix_size", size_of()).join(F.broadcast(sources) if small else sources, F.col("source").eqNullSafe(F.col("mix_source"))).drop("mix_source")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(1.0))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return joined.withColumn("mix_copies", (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long"))


def copies(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as the mix takes it, with the columns of docs."""
    own = [F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns)]  # whatever their names
    many = mix(docs.select(*own, "doc_id", "source", "text"), **how).where("mix_copies > 0")
    each = many.withColumn("mix_copy", F.explode(F.expr("sequence(1L, mix_copies)")))
    return each.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), named AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (ARRAY[5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER before, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM named WINDOW before AS (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), final AS (
  SELECT (SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, level LIMIT 1) AS level
), targets AS (
  SELECT source, source_size, coalesce(least(cap, final.level * weight), cap) AS target FROM levels, final
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0::DOUBLE END AS rate,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix-1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (draw < rate - floor(rate))::INT))::BIGINT AS taken FROM rated
"""
