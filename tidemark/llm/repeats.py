"""Operator 10: bytes covered by a string of 100 bytes that starts earlier too are removed.

Every window of 100 bytes has an anchor: the leftmost smallest hash among its 32-byte
substrings.  Successive windows of one anchor form a stretch (at most 168 bytes).  Equal
windows have equal anchor hashes at the same place, so only stretches that share an
anchor's hash can hold equal windows:

1. A scan makes stretches; each task keeps one of equal stretches and sends (anchor
   hash, stretch hash, place), packed, to buckets of anchor hashes.  A bucket tells
   which stretches repeat an earlier equal one (covered whole) and which share an
   anchor with different ones (to be compared).  Others hold no repeated window.
2. The texts concerned are fetched once; stretches to be compared are dealt out to
   shards by anchor hash.  There, runs of windows whose hashes recur are kept; their
   suffix array (induced sorting) and permuted common prefixes give the equal windows,
   exactly, and each window but the earliest is covered.
3. An anchor hash of more than ``HOT`` stretches, as at the edge of a passage that very
   many documents share, is cut into parts of about ``HOT`` stretches.  Each part goes
   through its suffix array like a shard and gives the first place of each of its
   windows; of these, all but the earliest of all parts (by 128-bit hash) are covered.

A task sends at most ``MANY`` stretches of one anchor hash to a bucket; beyond that they
are known to differ and go to comparison without asking.  So a bucket gets a bounded
number of rows a task for any anchor.

Defined cases: null text is empty and has no match; a null doc_id counts as the largest;
different texts with one doc_id are different documents, ordered by a hash of the text;
repeated rows are the same document and have equal results; texts longer than ``PIECE``
bytes are scanned in parts that overlap by a window; an empty table gives no rows; other
columns are ignored by ``report`` and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _bytes as B
from tidemark.llm import _files
from tidemark.llm.suffixes import common_prefixes, suffix_array

WINDOW, GRAM = 100, 32
SPAN = WINDOW - GRAM + 1  # substrings in a window
MANY, HOT = 64, 2000
CHUNK, BUCKET, SHARD = 8 << 20, 8 << 20, 1 << 20  # bytes of text that a task gathers; of text for a bucket; of stretches for a shard
PIECE, PART = 1 << 23, 1 << 19
NULL = (1 << 63) - 1
CELL = np.dtype([("h", "<u8"), ("f", "<u8"), ("d", "<i8"), ("v", "<i8"), ("start", "<i4"), ("length", "<i2"), ("anchor", "<i2")])
ANSWER = "d long, v long, start int, stop int, h long, anchor int"


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, stop, anchor, anchor hash, stretch hash, text) of the stretches of all texts; places in data."""
    n = len(data)
    if n < WINDOW:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    sums = B.prefix(data)
    at = np.arange(n - GRAM + 1)
    hashes = B.mix((sums[GRAM:] - sums[: n - GRAM + 1]) * B.powers(n)[1][: n - GRAM + 1])
    # the smallest of SPAN values from each place on: 40 bits of hash, then 24 of place (leftmost of equals)
    least = (hashes & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
    width = 1
    while width < SPAN:
        step = min(width, SPAN - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    valid = np.ones(len(anchor), bool)  # windows inside one text
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    if len(edges):
        cut = np.zeros(n + 1, np.int32)
        np.add.at(cut, np.maximum(edges - WINDOW + 1, 0), 1)
        np.add.at(cut, edges, -1)
        valid = np.cumsum(cut)[: len(anchor)] == 0
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + WINDOW
    anchor = anchor[start]
    return start, stop, anchor, hashes[anchor], B.spans(sums, start, stop), np.searchsorted(offsets, start, "right") - 1


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Blocks of whole texts (index of the first, bytes, offsets, 0), or parts of a very long one (..., place of the part in it)."""
    for first, data, offsets in B.blocks(texts):
        if len(data) <= PIECE:
            yield first, data, offsets, 0
            continue
        for a in range(0, max(1, len(data) - WINDOW + 1), PIECE):
            part = data[a : a + PIECE + WINDOW - 1]
            yield first, part, np.array([0, len(part)]), a


def _order(c: np.ndarray, *names: str) -> np.ndarray:
    return np.lexsort(tuple(c[k] for k in reversed(names)))


def _repeats(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """c sorted by h, f and place: (covered by an earlier equal one, first of its (h, f), number of different f with its h)."""
    new_h = np.append(True, c["h"][1:] != c["h"][:-1]) if len(c) else np.zeros(0, bool)
    new = new_h.copy()
    new[1:] |= c["f"][1:] != c["f"][:-1]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(c) else np.zeros(0, np.int64)
    covered = (c["d"] != c["d"][lead]) | (c["v"] != c["v"][lead]) | (c["start"] != c["start"][lead])
    group = np.cumsum(new_h) - 1
    return covered, new, np.bincount(group, new).astype(np.int64)[group] if len(c) else np.zeros(0, np.int64)


def _pack(c: np.ndarray) -> bytes:
    import zstandard

    c = c[_order(c, "d", "v", "start")]
    return zstandard.ZstdCompressor(level=1).compress(len(c).to_bytes(8, "little") + b"".join(np.ascontiguousarray(c[k]).tobytes() for k in CELL.names))


def _unpack(raw: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(raw)
    n, at = int.from_bytes(raw[:8], "little"), 8
    c = np.empty(n, CELL)
    for k in CELL.names:
        c[k] = np.frombuffer(raw, CELL[k], n, at)
        at += n * CELL[k].itemsize
    return c


def _answers(c: np.ndarray, compare: bool) -> tuple:
    """Columns of ANSWER; h is null for bytes that are covered whole, which are joined where they touch."""
    if compare or not len(c):
        start = c["start"].astype(np.int32)
        return c["d"], c["v"], start, start + c["length"].astype(np.int32), c["h"].view(np.int64), c["anchor"].astype(np.int32), np.full(len(c), not compare)
    c = c[_order(c, "d", "v", "start")]
    stop = c["start"].astype(np.int64) + c["length"]
    head = np.ones(len(c), bool)  # stretches of a text overlap their neighbours only
    head[1:] = (c["d"][1:] != c["d"][:-1]) | (c["v"][1:] != c["v"][:-1]) | (c["start"][1:] > stop[:-1])
    ends = np.append(np.flatnonzero(head)[1:], len(c)) - 1
    c, stop = c[head], stop[ends].astype(np.int32)
    return c["d"], c["v"], c["start"].astype(np.int32), stop, np.zeros(len(c), np.int64), np.zeros(len(c), np.int32), np.ones(len(c), bool)


def _table(c: np.ndarray, compare: bool) -> pa.RecordBatch:
    *columns, none = _answers(c, compare)
    return pa.RecordBatch.from_arrays([pa.array(x, mask=none if k > 3 else None) for k, x in enumerate(columns)], ["d", "v", "start", "stop", "h", "anchor"])


def identified(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (doc_id, if not given) as _0, _1, ..., with d and v, by which documents are ordered and told apart, and bytes."""
    text = F.coalesce("text", F.lit(""))
    own = [F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(carry or ["doc_id"])]
    return docs.select(*own, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL)).alias("d"), F.xxhash64(text).alias("v"), text.cast("binary").alias("bytes"))


def candidates(named: DataFrame, buckets: int) -> DataFrame:
    """Places that are covered whole (h null), and stretches to be compared."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, count = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, count
            c = np.concatenate(held) if held else np.zeros(0, CELL)
            held, size, count = [], 0, count + 1
            c = c[_order(c, "h", "f", "d", "v", "start")]
            covered, new, kinds = _repeats(c)
            many = kinds > MANY
            rank = np.cumsum(new) - 1  # among distinct stretches
            head = np.append(True, c["h"][1:] != c["h"][:-1]) if len(c) else np.zeros(0, bool)
            rank -= np.maximum.accumulate(np.where(head, rank, 0)) if len(c) else 0
            direct = new & many & (rank >= 2)  # two stay, from which others see that stretches differ
            send = c[new & ~direct]
            target = (B.mix(send["h"]) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(target, kind="stable")
            send, target = send[by], target[by]
            cuts = np.append(np.flatnonzero(np.append(True, target[1:] != target[:-1])), len(target)) if len(target) else [0]
            rows = [(int(target[a]), 0, _pack(send[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            for kind, part in ((1, c[covered]), (2, c[direct])):
                for k in range(0, len(part), 50_000):
                    rows.append((int(B.mix(part["h"][k : k + 1])[0] % np.uint64(buckets)), kind, _pack(part[k : k + 50_000])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "cell"])

        for batch in batches:
            d, v = (batch.column(k).to_numpy() for k in ("d", "v"))
            for first, data, offsets, shift in pieces(batch.column("bytes")):
                start, stop, anchor, h, f, owner = stretches(data, offsets)
                c = np.empty(len(start), CELL)
                c["h"], c["f"], c["d"], c["v"] = h, f, d[first + owner], v[first + owner]
                c["start"], c["length"], c["anchor"] = start - offsets[owner] + shift, stop - start, anchor - start
                held.append(c)
                size += len(data)
                if size >= CHUNK:
                    yield from flush()
        yield from flush()

    def reduce(key: tuple, group: pa.Table) -> pa.Table:
        kinds, cells = group.column("kind").to_pylist(), group.column("cell")
        join = lambda kind: np.concatenate([np.zeros(0, CELL), *(_unpack(x.as_py()) for x, k in zip(cells, kinds, strict=True) if k == kind)])
        c = join(0)
        c = c[_order(c, "h", "f", "d", "v", "start")]
        covered, new, kinds_of_h = _repeats(c)
        return pa.Table.from_batches([_table(np.concatenate([c[covered], join(1)]), False), _table(np.concatenate([c[new & (kinds_of_h > 1)], join(2)]), True)])

    cells = named.select("d", "v", "bytes").mapInArrow(B.tidy(scan), "bucket int, kind int, cell binary")
    return cells.groupBy("bucket").applyInArrow(reduce, ANSWER)


def compared(texts: DataFrame) -> DataFrame:
    """The stretches to be compared, cut out of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.column(batch.column("bytes"))
            lists = batch.column("compare")
            many = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), many)
            start, stop = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "stop"))
            for a in range(0, len(row), 100_000):
                s, r = slice(a, a + 100_000), row[a : a + 100_000]
                length = stop[s] - start[s]
                cut = data[B.ragged(offsets[r] + start[s], length)]
                strings = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(length)]).astype(np.int32).tobytes()), pa.py_buffer(cut.tobytes())])
                at = pa.array(r)
                yield pa.RecordBatch.from_arrays([batch.column("d").take(at), batch.column("v").take(at), pa.array(start[s].astype(np.int32)), flat.field("h").slice(a, len(r)), flat.field("anchor").slice(a, len(r)), strings], ["d", "v", "start", "h", "anchor", "string"])

    return texts.where("size(compare) > 0").select("d", "v", "bytes", "compare").mapInArrow(B.tidy(run), "d long, v long, start int, h long, anchor int, string binary")


COVERED = "d long, v long, start int, stop int"


def _joined(d: np.ndarray, v: np.ndarray, start: np.ndarray) -> pa.Table:
    """Windows as COVERED rows, joined where they touch."""
    order = np.lexsort((start, v, d))
    d, v, start = d[order], v[order], start[order].astype(np.int64)
    head = np.ones(len(d), bool)
    head[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1]) | (start[1:] > start[:-1] + WINDOW)
    ends = np.append(np.flatnonzero(head)[1:], len(d)) - 1 if len(d) else np.zeros(0, np.int64)
    return pa.table({"d": d[head], "v": v[head], "start": start[head].astype(np.int32), "stop": (start[ends] + WINDOW).astype(np.int32)})


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first, last window) of runs of windows whose hashes occur twice or more: others are equal to none."""
    many = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
    owner, at = np.repeat(np.arange(len(many)), many), B.ragged(offsets[:-1], many)
    hashes = B.spans(B.prefix(data), at, at + WINDOW)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    twice = np.zeros(len(at) + 1, bool)  # the last is False
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    last = np.flatnonzero(twice[:-1] & (edge | ~twice[1:]))
    first = np.flatnonzero(twice[:-1] & np.concatenate([[True], edge[:-1] | ~twice[: len(at) - 1]])[: len(at)])
    return owner[first], at[first], at[last]


def _shard(key: tuple, group: pa.Table) -> pa.Table:
    """COVERED rows of a shard's stretches; anchor hashes are taken together up to about PART bytes.  Of a part of a hot anchor hash, also the first of each window."""
    B.turn()
    group = group.sort_by("h").combine_chunks()
    size, h = B.column(group.column("string").combine_chunks())[1][1:], group.column("h").to_numpy()
    ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
    cuts, first = [0], 0
    for e in ends.tolist():
        if size[e - 1] - first >= PART or e == len(h):
            cuts.append(e)
            first = size[e - 1]
    found = pa.concat_tables([_compare(group.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    for name in ("w1", "w2"):
        found = found.append_column(name, pa.nulls(found.num_rows, pa.int64()))
    return pa.concat_tables([found, _firsts(group)]) if key[0].is_valid else found


def _firsts(group: pa.Table) -> pa.Table:
    """The first place of each window of the stretches, with the window's 128-bit hash."""
    data, bounds = B.column(group.column("string").combine_chunks())
    many = np.maximum(np.diff(bounds) - WINDOW + 1, 0)
    row, at = np.repeat(np.arange(len(many)), many), B.ragged(bounds[:-1], many)
    eight = np.lib.stride_tricks.as_strided(data, (max(0, len(data) - 7), 8), (1, 1)).copy().view("<u8").reshape(-1)
    w1, w2 = np.full(len(at), 0x243F6A8885A308D3, np.uint64), np.full(len(at), 0x13198A2E03707344, np.uint64)
    for k in (*range(0, WINDOW - 8, 8), WINDOW - 8):
        word = eight[at + k]
        w1, w2 = B.mix(w1 ^ word) + np.uint64(0xA4093822299F31D1), B.mix(w2 * np.uint64(0xD6E8FEB86659FD93) + word)
    d, v, start = (group.column(k).combine_chunks().to_numpy()[row] for k in ("d", "v", "start"))
    start = start + (at - bounds[:-1][row])
    order = np.lexsort((start, v, d, w2, w1))
    w1, w2 = w1[order], w2[order]
    new = np.ones(len(order), bool)
    new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
    keep, start = order[new], start.astype(np.int32)
    return pa.table({"d": d[keep], "v": v[keep], "start": start[keep], "stop": start[keep] + np.int32(WINDOW), "w1": w1[new].view(np.int64), "w2": w2[new].view(np.int64)})


def _compare(group: pa.Table) -> pa.Table:
    raw, bounds = B.column(group.column("string").combine_chunks())
    row, first, last = _runs(raw, bounds)
    n, length = len(row), last - first + WINDOW
    data, offsets = raw[B.ragged(first, length)], np.concatenate([[0], np.cumsum(length)])
    first -= bounds[row]
    # one text: each stretch and a letter below all bytes; bytes take values 1 to 256 in the array's alphabet
    begin = offsets[:-1] + np.arange(n)
    letters = np.zeros(len(data) + n, np.int16)
    place = B.ragged(begin, length)
    letters[place] = data.astype(np.int16) + 1
    sa = suffix_array(letters)
    raw = np.zeros(len(letters), np.uint8)
    raw[place] = data
    prefixes = common_prefixes(raw, sa, WINDOW)
    owner = np.repeat(np.arange(n), length + 1)
    inside = np.arange(len(letters)) - begin[owner]
    window = inside <= length[owner] - WINDOW
    # in the array's order: equal windows are neighbours with a common prefix of WINDOW bytes
    window_sa = window[sa]
    joins = np.zeros(len(sa), bool)
    joins[1:] = (prefixes[sa[1:]] >= WINDOW) & window_sa[1:] & window_sa[:-1]
    group_of = np.cumsum(~joins)
    at, g = sa[window_sa], group_of[window_sa]
    d, v, start = (group.column(k).combine_chunks().to_numpy()[row] for k in ("d", "v", "start"))
    wd, wv, ws = d[owner[at]], v[owner[at]], (start + first)[owner[at]] + inside[at]
    order = np.lexsort((ws, wv, wd, g))
    g, wd, wv, ws = g[order], wd[order], wv[order], ws[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    lead = np.repeat(first, np.diff(np.append(first, len(g))))
    later = (wd != wd[lead]) | (wv != wv[lead]) | (ws != ws[lead])
    return _joined(wd[later], wv[later], ws[later])


def covered(strings: DataFrame, size: int) -> DataFrame:
    """COVERED rows from the stretches to be compared."""
    parts = strings.groupBy("h").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")).where("parts > 1")
    parts = _files.stored(parts, "hot")
    shard = F.pmod(F.xxhash64("h"), F.lit(max(4, size // SHARD)))
    dealt = strings.select("d", "v", "start", "h", "string")
    if parts.isEmpty():
        dealt = dealt.withColumns({"hot": F.lit(None).cast("long"), "shard": shard})
    else:
        part = F.pmod(F.xxhash64("d", "v", "start"), F.col("parts"))
        dealt = dealt.join(parts, "h", "left").withColumns({"hot": F.when(F.col("parts").isNotNull(), F.col("h")), "shard": F.coalesce(part, shard)}).drop("parts")
    found = dealt.groupBy("hot", "shard").applyInArrow(_shard, f"{COVERED}, w1 long, w2 long")
    if parts.isEmpty():
        return found.drop("w1", "w2")
    found = _files.stored(found, "compared")
    firsts, place = found.where("w1 is not null"), F.struct("d", "v", "start")
    least = firsts.groupBy("w1", "w2").agg(F.min(place).alias("f"), F.count("*").alias("n")).where("n > 1").select("w1", "w2", "f")
    later = firsts.join(least, ["w1", "w2"]).where(place != F.col("f"))  # one row a window and part
    return found.where("w1 is null").select("d", "v", "start", "stop").union(later.select("d", "v", "start", "stop"))


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = B.column(batch.column("bytes"))
        lists = batch.column("gone")
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = lists.flatten()
        start, stop = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "stop"))
        rows = []
        for k in range(batch.num_rows):
            text = data[offsets[k] : offsets[k + 1]]
            s, e = start[ends[k] : ends[k + 1]], stop[ends[k] : ends[k + 1]]
            order = np.argsort(s, kind="stable")
            s, e = s[order], np.maximum.accumulate(e[order]) if len(e) else e
            new = np.append(True, s[1:] > e[:-1]) if len(s) else np.zeros(0, bool)
            s, e = s[new], e[np.append(np.flatnonzero(new)[1:], len(new)) - 1] if len(s) else e
            gone = np.zeros(len(text) + 1, np.int8)
            gone[s] += 1
            gone[e] -= 1
            left = text[np.cumsum(gone[:-1], dtype=np.int8) == 0].tobytes()
            rows.append((int((e - s).sum()), len(s), left))
        removed, spans, left = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("v"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(left, pa.binary())], ["d", "v", "n_removed", "n_spans", "left"])


def removed(docs: DataFrame, carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(docs as identified() gives them; d, v, n_removed, n_spans and left, the remaining bytes, of documents that lose some)."""
    named = identified(docs, carry)
    size = named.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    answers = _files.stored(candidates(named, max(4, size // BUCKET)), "candidates")
    places = answers.groupBy("d", "v").agg(
        F.collect_list(F.when(F.col("h").isNull(), F.struct("start", "stop"))).alias("whole"),
        F.collect_list(F.when(F.col("h").isNotNull(), F.struct("start", "stop", "h", "anchor"))).alias("compare"),
    )
    texts = _files.stored(named.select("d", "v", "bytes").join(places, ["d", "v"]).dropDuplicates(["d", "v"]), "texts")
    strings = _files.stored(compared(texts), "strings")
    found = _files.stored(covered(strings, strings.agg(F.sum(F.length("string"))).first()[0] or 0), "covered")
    more = found.groupBy("d", "v").agg(F.collect_list(F.struct("start", "stop")).alias("more"))
    both = texts.select("d", "v", "bytes", "whole").join(more, ["d", "v"], "left")
    gone = F.concat("whole", F.coalesce("more", F.expr("cast(array() as array<struct<start:int,stop:int>>)")))
    both = both.select("d", "v", "bytes", gone.alias("gone")).where("size(gone) > 0")
    return named, both.mapInArrow(B.tidy(_results), "d long, v long, n_removed long, n_spans long, left binary")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    named, lost = removed(docs)
    whole = named.select(F.col("_0").alias("doc_id"), "d", "v", F.octet_length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("sha"))
    lost = lost.select("d", "v", "n_removed", "n_spans", F.sha2("left", 256).alias("left_sha"))
    zero = F.lit(0).cast("long")
    return whole.join(lost, ["d", "v"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("left_sha", "sha").alias("kept_sha256"))


def clean(docs: DataFrame) -> DataFrame:
    """docs with what is left of each text, and n_chars counted anew; documents of which nothing is left go.  A character that loses some of its bytes is removed whole."""
    named, lost = removed(docs, docs.columns)
    lost = _files.stored(lost.select("d", "v", "left"), "left")
    decode = F.pandas_udf(lambda s: s.map(lambda b: bytes(b).decode("utf-8", "ignore"), na_action="ignore"), "string")
    lost = lost.select("d", "v", decode("left").alias("left"))
    out = named.join(lost, ["d", "v"], "left").where("left is null or left <> ''")
    fresh = {"text": F.col("left"), "n_chars": F.char_length("left").cast("long")}
    own = {c: F.col(f"_{k}") for k, c in enumerate(docs.columns)}
    return out.select(*[(F.when(F.col("left").isNotNull(), fresh[c]).otherwise(x) if c in fresh else x).alias(c) for c, x in own.items()])


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH docs AS (
  SELECT doc_id, hex(coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS n FROM documents
), chunks AS (
  SELECT doc_id, n, k, substr(x, 512 * k + 1, 710) AS chunk FROM (SELECT *, unnest(range(0, n // 256 + 1)) AS k FROM docs)
), windows AS (
  SELECT doc_id, 256 * k + i AS p, substr(chunk, 2 * i + 1, 200) AS w FROM (SELECT *, unnest(range(0, greatest(0, least(256, n - 99 - 256 * k)))) AS i FROM chunks)
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS r FROM windows) WHERE r > 1
), marked AS (
  SELECT doc_id, p, coalesce(p > lag(p) OVER w + 100, true) AS head FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY p)
), spans AS (
  SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT doc_id, p, count(CASE WHEN head THEN 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM marked) GROUP BY doc_id, s
), befores AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM spans
), lost AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(any_x, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS kept
  FROM (SELECT befores.*, docs.x AS any_x FROM befores JOIN docs USING (doc_id)) GROUP BY doc_id
)
SELECT docs.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN lost ON docs.doc_id = lost.doc_id
"""
