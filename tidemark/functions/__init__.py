"""Scalar functions: the FNV-1a shard index, traits, and the sizing rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_BASIS, FNV_PRIME = 2166136261, 16777619


def fnv1a(key: str) -> Column:
    """32-bit FNV-1a of a string column's UTF-8 bytes, as a long."""
    raw = f"encode({key}, 'UTF-8')"
    byte = f"cast(conv(hex(substring({raw}, i, 1)), 16, 10) as bigint)"
    step = f"((h ^ {byte}) * {FNV_PRIME}L) & 4294967295L"
    indices = f"if(octet_length({raw}) > 0, sequence(1, octet_length({raw})), cast(array() as array<int>))"
    return F.expr(f"aggregate({indices}, {FNV_BASIS}L, (h, i) -> {step})")


def shard_index(key: str, shards: int) -> Column:
    if shards < 2 or shards & (shards - 1):
        raise ValueError("the number of shards is a power of two, 2 or more")
    return F.expr(f"cast({shards - 1} as bigint)").bitwiseAND(fnv1a(key)).cast("int")


def trait_names(traits: Column, names: dict[str, int]) -> Column:
    return F.array_compact(F.array(*[F.when(traits.bitwiseAND(bit) != 0, F.lit(name)) for name, bit in names.items()]))


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def power_of_two(n: int) -> int:
    """The least power of two that is n or more."""
    return 1 << max(0, n - 1).bit_length()


def metrics_buffer(keys: int, per_key: int) -> int:
    return clamp(5 * keys * per_key, 20_000, 100_000)


def ingest_length(keys: int) -> int:
    return 5000 if keys < 50 else 100_000 if keys > 1000 else 100 * keys


def idle_workers(keys: int, shards: int) -> int:
    return -(-keys // shards)
