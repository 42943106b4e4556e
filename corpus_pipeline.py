"""The corpus pipeline: quality rules, near-dedup, repeated passages, mixing, packing.

Each stage reads what its predecessor wrote; ``run`` writes every stage but the last as
Parquet in the shared folder, reads it again, and deletes what was written for it and for
the stage before.

Defined cases, for each stage: null, empty and blank texts fail the base rules of
quality_rules; in near_dedup they are linked with nothing and stay, in repeated_passages they
have no bytes and stay, in source_mix their size is 0, in packing they are an end id alone.
A null doc_id is no reason to drop a row: it is linked with nothing, comes last among repeats,
draws like any other value in the mix and is packed.  Null lang and source are values of
their own.  Repeated rows count each in quality_rules, are one document in near_dedup (its
rows stay or go together) and in repeated_passages, draw alike in source_mix, and are packed
each for itself.  Very long texts are read whole by all stages.  Of equal texts the smallest doc_id
stays.  Other columns come through all stages but the last, whatever their names.  An empty
table gives an empty table.

near_dedup takes op9's shingles of three words and 85 %, which its contract fixes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import _files, minhash, mixing, outliers, packing, repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the robust distances reject."""
    return outliers.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each component of near duplicates."""
    return minhash.keep(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start earlier too; documents of which nothing is left go."""
    return repeats.clean(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens, with checksums of their ids."""
    return packing.pack_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packing", packed),
]

#: Robust estimates and tokenizers can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = len(_files.made)
    for name, stage in STAGES[:-1]:
        docs = _files.settled(stage(spark, docs, sf_dir), name, since)
    return STAGES[-1][1](spark, docs, sf_dir)
