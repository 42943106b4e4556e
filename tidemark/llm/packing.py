"""Operator 8: harmonic packing of tokenised documents into fixed-length sequences.

Piece lengths are the reciprocal-capacity classes capacity/1, capacity/2, capacity/4,
... 1.  A document's ids are cut into as many whole-capacity pieces as fit, then into
the powers of two of what is left, longest first.  Each class fills its own bins with
a fixed number of pieces, in every worker alone, so nothing is shuffled and a bin of
any class is exactly full.  What is left in a class's last bin is cut at the powers of
two of its number of pieces: those sequences have a power-of-two length and need no
padding either.  A worker holds back at most one open bin of each class.

Defined cases: null text packs as the empty text (only the end id); a null doc_id is
kept; repeated rows are packed each for itself; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import _bytes as B

CAPACITY, END_ID = 4096, 2
SEQUENCES = 1 << 36  # sequence ids of one worker's partition


def _packer(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, joins_spaces: bool = False) -> tuple[Callable, str]:
    """What makes a worker's texts pieces, and the pieces' columns before ids."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity is a power of two")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long"
    classes = [1 << k for k in range(capacity.bit_length() - 1, -1, -1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidemark.llm._ids import encoder

        table = encoder(tokenizer, joins_spaces)
        base, used = TaskContext.get().partitionId() * SEQUENCES, 0
        rest: dict[int, tuple] = {}

        def made(rows: tuple, sequence: np.ndarray, offset: np.ndarray, size: int) -> pa.RecordBatch:
            ids, start, total, matrix = rows
            n = len(start)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(matrix.reshape(-1), pa.int32()))
            return pa.RecordBatch.from_arrays([ids, *map(pa.array, (start, np.full(n, size, np.int64), total, base + sequence, offset)), lists], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for first, _, offsets in B.blocks(batch.column("text"), B.BLOCK):
                n = len(offsets) - 1
                doc_ids = batch.column("doc_id").slice(first, n)
                flat, at = table.encode(batch.column("text").slice(first, n), end_id)
                length = np.diff(at)
                done = np.zeros(n, np.int64)
                for size in classes:
                    many = length // capacity if size == capacity else (length // size) & 1
                    row = np.repeat(np.arange(n), many)
                    if not len(row):
                        continue
                    start = done[row] + size * (np.arange(len(row)) - (np.cumsum(many) - many)[row])
                    done += many * size
                    new = (doc_ids.take(pa.array(row)), start, length[row], flat[(at[:-1][row] + start)[:, None] + np.arange(size)])
                    if old := rest.get(size):
                        new = (pa.concat_arrays([old[0], new[0]]), *(np.concatenate([a, b]) for a, b in zip(old[1:], new[1:], strict=True)))
                    fits = capacity // size
                    full = len(new[1]) // fits * fits
                    if full:
                        k = np.arange(full)
                        for a in range(0, full, many_rows := max(1, (1 << 21) // size)):
                            part = k[a : a + many_rows]
                            yield made((new[0].slice(a, len(part)), *(x[a : a + len(part)] for x in new[1:])), used + part // fits, part % fits * size, size)
                        used += full // fits
                    rest[size] = (new[0].slice(full), *(x[full:] for x in new[1:]))
        for size, rows in rest.items():
            left, a = len(rows[1]), 0
            for bit in range(left.bit_length() - 1, -1, -1):
                if left >> bit & 1:
                    k = np.arange(1 << bit)
                    yield made((rows[0].slice(a, 1 << bit), *(x[a : a + (1 << bit)] for x in rows[1:])), np.full(1 << bit, used), k * size, size)
                    used, a = used + 1, a + (1 << bit)

    return run, schema


def pack(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset and ids.  how: end_id, capacity and joins_spaces."""
    run, schema = _packer(docs, tokenizer, **how)
    return docs.select("doc_id", "text").mapInArrow(B.tidy(run, False), f"{schema}, ids array<int>")


def pack_digests(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """digests(pack(...)); the ids are summed by the worker that has made them and never leave it."""
    pieces, schema = _packer(docs, tokenizer, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield _summed(batch, "ids")

    return docs.select("doc_id", "text").mapInArrow(B.tidy(run, False), f"{schema}, ids_crc32 long")


def _summed(batch: pa.RecordBatch, column: str) -> pa.RecordBatch:
    names, lists = [c for c in batch.schema.names if c != column], batch.column(column)
    values = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64) * 4
    sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sums, pa.int64())], [*names, "ids_crc32"])


def digests(pieces: DataFrame, column: str = "ids") -> DataFrame:
    """The pieces with ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in place of the ids."""
    names = [c for c in pieces.columns if c != column]
    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in names) + ", ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _summed(batch, column)

    return pieces.mapInArrow(B.tidy(run, False), schema)


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_digests(docs, public_tokenizers.path("word_bpe_49k.json"))
