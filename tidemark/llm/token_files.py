"""Operator 2: token ids as Parquet list columns, in ascending doc_id order.

``write`` range-partitions the documents by doc_id, encodes each partition in order and
writes one shard a partition: doc_id, shard, local_start, n_tokens (delta encoded by the
second data-page version) and tokens (a list column, dictionary encoded).  Row groups
and pages have set sizes, and Spark's writer adds column and offset indexes, so a
reader that filters on doc_id touches a few pages, and one that doesn't select tokens
reads no tokens.  The first id of each shard is in a small table beside it (one row a
shard), so a document's global start is one addition and no id is written twice.

Defined cases: null text is the empty text; null doc_ids come first; repeated doc_ids
stay in text order; a very long text is tokenised whole, in a block of its own; an empty
table gives empty files; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import _bytes as B
from tidemark.llm import _files
from tidemark.llm.packing import digests

END_ID = 0
#: Bytes of text for one shard, and the sizes of row groups and pages; beyond SHARDS shards, these grow instead.
SHARD, ROW_GROUP, PAGE, SHARDS = 16 << 20, 32 << 20, 256 << 10, 100_000


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, joins_spaces: bool = True, shards: int | None = None) -> None:
    """Writes path/tokens and path/shards."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if shards is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = min(SHARDS, max(1, -(-size // SHARD), min(spark.sparkContext.defaultParallelism, size >> 20)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidemark.llm._ids import encoder

        table, shard, done = encoder(tokenizer, joins_spaces), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, _, offsets in B.blocks(batch.column("text"), B.BLOCK):
                n = len(offsets) - 1
                flat, at = table.encode(batch.column("text").slice(first, n), end_id)
                tokens = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), pa.array(np.full(n, shard, np.int32)), pa.array(done + at[:-1]), pa.array(np.diff(at)), tokens], ["doc_id", "shard", "local_start", "n_tokens", "tokens"])
                done += int(at[-1])

    ranges = docs.repartitionByRange(shards, "doc_id", F.substring("text", 1, 64))  # a doc_id of very many rows is cut too
    rows = ranges.sortWithinPartitions("doc_id", "text").mapInArrow(B.tidy(run, False), f"doc_id {kind}, shard int, local_start long, n_tokens long, tokens array<int>")
    options = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.page.row.count.limit": 2000, "parquet.enable.dictionary": "false", "parquet.enable.dictionary#tokens.list.element": "true"}
    rows.write.options(**options).parquet(f"{path}/tokens")
    totals = spark.read.parquet(f"{path}/tokens").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))  # SHARDS rows at most
    totals.select("shard", F.coalesce(before, F.lit(0)).cast("long").alias("first_id")).coalesce(1).write.parquet(f"{path}/shards")


def read(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """Documents of a written folder: doc_id, start, n_tokens, and tokens if asked for.  Filters on doc_id reach the scan."""
    rows = spark.read.parquet(f"{path}/tokens")
    firsts = spark.read.parquet(f"{path}/shards")
    out = rows.join(F.broadcast(firsts), "shard")  # SHARDS rows at most, about 2 MB
    return out.select("doc_id", (F.col("first_id") + F.col("local_start")).alias("start"), "n_tokens", *["tokens"] * tokens)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = _files.place(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digests(read(spark, path), "tokens")
