"""Vectorised work on the UTF-8 bytes of many texts at once (numpy over Arrow buffers).

Texts arrive as Arrow string columns.  ``blocks`` cuts a column into runs of whole
texts of about ``BLOCK`` bytes, so that the temporaries of one step stay small; only
a single text longer than that makes a larger block (about 40 bytes of memory for
each byte of that text).
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.RandomState(20240229).randint(0, 1 << 63, 256, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
#: What other modules keep in a worker between tasks; ``turn`` drops it.
kept: list = []
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def turn() -> None:
    """For operators that keep nothing in a worker: what another operator left there goes back to the system."""
    while kept:
        kept.pop().clear()
    trim()


def trim() -> None:
    """What a task has freed goes back to the system: an idle worker would keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable, turns: bool = True) -> Callable:
    """run, a function over a task's batches, with a turn() before it (but for operators that keep something) and a trim() after it."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if turns:
            turn()
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n, kept between calls."""
    if len(_powers[0]) <= n:
        size = max(n + 1, BLOCK + 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not (large or pa.types.is_string(texts.type) or pa.types.is_binary(texts.type)):
        texts, large = texts.cast(pa.large_string()), True
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    n = len(texts)
    _, offsets, data = texts.buffers()
    kind = np.int64 if large else np.int32
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of runs of whole texts of about ``most`` bytes."""
    data, offsets = column(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def prefix(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Running sums from which ``spans`` takes the hash of any stretch of bytes."""
    values = _VALUES[_LOWER] if lower else _VALUES
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data))[0][: len(data)], dtype=np.uint64, out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of bytes [start, end), the same wherever in a block they lie."""
    return mix((sums[end] - sums[start]) * powers(len(sums) - 1)[1][start] + (end - start).astype(np.uint64))


def heads(offsets: np.ndarray, n: int) -> np.ndarray:
    """True at the first byte of each text that isn't empty."""
    out = np.zeros(n, bool)
    at = offsets[:-1]
    out[at[at < n]] = True
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each one's text."""
    n = len(data)
    inside, first = ~_SPACE[data], heads(offsets, n)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:] & ~first[1:]
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def triples(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of three words inside one text, and the first word's index."""
    if len(hashes) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[2:] == owner[:-2])
    return mix(hashes[at] * np.uint64(0xD6E8FEB86659FD93) + mix(hashes[at + 1] * np.uint64(0xA0761D6478BD642F) + mix(hashes[at + 2] + np.uint64(0xE7037ED1A0B428DB)))), at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each pair, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
