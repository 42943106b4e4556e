"""Operator 1: quality rules by robust multivariate outliers.

Each text gives counts and a vector of transformed statistics.  For each language and
source a minimum-covariance-determinant estimate is made by concentration steps: from
coordinatewise medians, take the share ``SUBSET`` of documents with the smallest
distances, estimate mean and covariance from them, measure again.  Every step covers
all documents and is one aggregation to (group, distance bin) cells, each with count,
sums and products, so a hot source is summed before the shuffle and no group's rows
meet in a task.  Statistics are whole multiples of 1/1024, so sums don't depend on
their order.  A document is rejected if its squared Mahalanobis distance to the
reweighted estimate exceeds the chi-square value with probability ``TAIL`` above it.
Real texts have heavier tails than the normal distribution: on labelled rows clean texts
(with a line or two repeated) reach 104 and junk starts at 168, so the cut lies between.

A group of fewer than ``LEAST`` documents that pass the base rules is judged by the
estimate from all documents of its language, or else from all documents; if those are
too few as well there is no estimate, and only the base rules reject.  ``SPREAD`` is the least standard deviation that a statistic
is given: texts without any symbol would else make one symbol an outlier.

Defined cases: null, empty and blank texts have no words and fail the base rules; null
lang or source is a value of its own; repeated rows count each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import _bytes as B
from tidemark.llm import _files

#: Names of the statistics, and the least standard deviation of each.
STATISTICS = ("log_words", "log_word_length", "symbols_per_word", "duplicate_lines", "repeated_words", "log_distinct")
SPREAD = (0.5, 0.06, 0.03, 0.2, 0.2, 0.06)
LEAST, SUBSET, STEPS, TAIL = 100, 0.6, 4, 1e-24
#: Groups up to this number (about 400 bytes each) are broadcast with their estimates.
BROADCAST_ROWS = 10_000
UNIT, BINS = 1024, 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
D = len(STATISTICS)
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def count(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text, as the base rules and statistics need them."""
    parts = []
    for _, data, offsets in B.blocks(texts):
        n = len(offsets) - 1
        start, end, owner = B.words(data, offsets)
        sums = B.prefix(data)
        hashes = B.spans(sums, start, end)
        per = lambda at, weights=None: np.bincount(at, weights, n).astype(np.int64)
        out = {"n_words": per(owner)}
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        out["word_chars"] = per(owner, points[end] - points[start])
        signs = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
        out["n_symbols"] = signs[offsets[1:]] - signs[offsets[:-1]]
        out["n_distinct"] = distinct(hashes, owner, n)
        # lines with a word: from each text's start or after \n, to \n or the text's end
        breaks = np.flatnonzero(data == 10)
        line_owner = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
        line_start = np.concatenate([offsets[:-1], breaks + 1])
        order = np.lexsort((line_start, line_owner))
        line_owner, line_start = line_owner[order], line_start[order]
        line_end = np.append(line_start[1:], len(data) + 1) - 1
        last = np.append(line_owner[1:] != line_owner[:-1], True) if len(line_owner) else np.zeros(0, bool)
        line_end[last] = offsets[1:][line_owner[last]]
        filled = np.searchsorted(start, line_start) < np.searchsorted(start, line_end)
        line_owner, line_start, line_end = line_owner[filled], line_start[filled], line_end[filled]
        out["n_lines"] = per(line_owner)
        out["n_dup_lines"] = out["n_lines"] - distinct(B.spans(sums, line_start, line_end), line_owner, n)
        # words in windows of three that occur twice or more in the text
        windows, at = B.triples(hashes, owner)
        mark = np.zeros(len(start) + 3, np.int64)
        if len(windows):
            order = np.lexsort((windows, owner[at]))
            same = (windows[order][1:] == windows[order][:-1]) & (owner[at][order][1:] == owner[at][order][:-1])
            twice = np.zeros(len(windows), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            np.add.at(mark, at[twice], 1)
            np.add.at(mark, at[twice] + 3, -1)
        out["n_repeat_words"] = per(owner, np.cumsum(mark)[: len(start)] > 0)
        parts.append(out)
    names = ("n_words", "word_chars", "n_symbols", "n_distinct", "n_lines", "n_dup_lines", "n_repeat_words")
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in names}


def distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The number of different hashes of each owner."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n).astype(np.int64)


def vector(c: dict[str, np.ndarray]) -> np.ndarray:
    """Transformed statistics, rounded to multiples of 1/UNIT; one row a text."""
    words, lines = np.maximum(1, c["n_words"]), np.maximum(1, c["n_lines"])
    columns = (np.log(words), np.log(np.maximum(1, c["word_chars"]) / words), c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, np.log(np.maximum(1, c["n_distinct"]) / words))
    return np.rint(np.stack(columns, 1) * UNIT) / UNIT


def statistics(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The carried columns of every document (doc_id, lang and source, if not given) and a struct q of its counts, base_failed and the vector x."""
    carry = carry or ["doc_id", "lang", "source"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = count(batch.column("q"))
            x = vector(c)
            failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * D, pa.int32()), pa.array(x.reshape(-1)))
            q = pa.StructArray.from_arrays([*(pa.array(c[k]) for k in COUNTS), pa.array(failed), lists], [*COUNTS, "base_failed", "x"])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(carry))), q], [*carry, "q"])

    fields = [docs.schema[c] for c in carry]
    q = T.StructType([T.StructField(k, T.LongType()) for k in COUNTS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    return docs.select(*[F.col(f"`{c}`") for c in carry], F.col("text").alias("q")).mapInArrow(B.tidy(run), T.StructType([*fields, T.StructField("q", q)]))


def chi_square(p: float, d: int) -> float:
    """The quantile for an even number of degrees of freedom."""
    return chi_square_above(1 - p, d)


def chi_square_above(tail: float, d: int) -> float:
    """The value with this probability above it."""

    def above(x: float) -> float:
        term = total = math.exp(-x / 2)
        for k in range(1, d // 2):
            term *= x / 2 / k
            total += term
        return total

    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) > tail else (low, mid)
    return high


def _below(x: float, d: int) -> float:
    term = total = math.exp(-x / 2)
    for k in range(1, d // 2):
        term *= x / 2 / k
        total += term
    return 1 - total


ESTIMATE = "grp long, n_estimated long, center array<double>, inverse array<double>"


def _estimate(grp: int, n: int, total: float, sums: np.ndarray, products: np.ndarray, share: float) -> pd.DataFrame:
    center = sums / total
    cov = np.zeros((D, D))
    for value, (i, j) in zip(products / total, PAIRS, strict=True):
        cov[i, j] = cov[j, i] = value - center[i] * center[j]
    if share < 1:  # consistency at the normal distribution
        cov *= share / _below(chi_square(share, D), D + 2)
    least = np.array(SPREAD)
    cov[np.diag_indices(D)] += np.maximum(least**2 - np.diag(cov), 0) + 1e-9
    inverse = np.linalg.inv(cov)
    return pd.DataFrame([[grp, n, center.tolist(), [inverse[i, j] for i, j in PAIRS]]], columns=["grp", "n_estimated", "center", "inverse"])


def _medians(cells: pd.DataFrame) -> pd.DataFrame:
    """The start: medians and scaled median deviations of each statistic, from (statistic, value bin) counts."""
    center, scale = np.zeros(D), np.zeros(D)
    for k in range(D):
        c = cells[cells.k == k].sort_values("value")
        v, w = c.value.to_numpy(), c.n.to_numpy()
        center[k] = v[np.searchsorted(np.cumsum(w), w.sum() / 2)]
        order = np.argsort(np.abs(v - center[k]), kind="stable")
        scale[k] = 1.4826 * np.abs(v - center[k])[order][np.searchsorted(np.cumsum(w[order]), w.sum() / 2)]
    scale = np.maximum(scale, SPREAD)
    return pd.DataFrame([[int(cells.grp.iloc[0]), int(cells.n[cells.k == 0].sum()), center.tolist(), [1 / scale[i] ** 2 if i == j else 0.0 for i, j in PAIRS]]], columns=["grp", "n_estimated", "center", "inverse"])


def _concentrate(share: float | None):
    """share: of the nearest rows to estimate from; None: those within the 0.975 quantile."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("bin")
        n = cells.n.to_numpy()
        if share is None:
            take = max(1, int((cells.bin <= _bin(chi_square(0.975, D))).sum()))
        else:
            take = int(np.searchsorted(np.cumsum(n), math.ceil(share * n.sum()))) + 1
        c = cells.iloc[:take]
        total = float(c.n.sum())
        real = total / n.sum() if share is not None else 0.975
        return _estimate(int(cells.grp.iloc[0]), int(n.sum()), total, np.array([c[f"s{k}"].sum() for k in range(D)]), np.array([c[f"p{k}"].sum() for k in range(len(PAIRS))]), min(real, 1.0))

    return run


def _bin(distance: float) -> int:
    return math.floor(math.log2(distance + 1e-6) * BINS)


def distance():
    """The squared Mahalanobis distance, from columns x, center and inverse."""
    d = [F.col("x")[k] - F.col("center")[k] for k in range(D)]
    terms = [F.col("inverse")[k] * d[i] * d[j] * F.lit(1.0 if i == j else 2.0) for k, (i, j) in enumerate(PAIRS)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.when(total.isNotNull(), F.greatest(total, F.lit(0.0)))


class Model:
    """Groups (lang, source to grp) and the estimate of each grp, as small tables."""

    def __init__(self, groups: DataFrame, many: int) -> None:
        self.groups, self.many, self.estimate = groups, many, None

    def small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.many <= BROADCAST_ROWS else df

    def place(self, rows: DataFrame) -> DataFrame:
        """rows with grp; 0 where nothing is estimated."""
        match = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
        return rows.join(self.small(self.groups), match).drop("g_lang", "g_source")

    def measure(self, placed: DataFrame, how: str = "inner") -> DataFrame:
        return placed.join(self.small(self.estimate), "grp", how).withColumn("distance", distance()).drop("center", "inverse", "n_estimated")


def _groups(rows: DataFrame, least: int) -> Model:
    sizes = rows.groupBy("lang", "source").agg(F.count(F.when(~F.col("q.base_failed"), 1)).alias("n"))
    langs = sizes.groupBy(F.col("lang").alias("l_lang")).agg(F.sum("n").alias("l_n"), (F.min("n") < least).alias("l_needed"))
    whole = sizes.agg(F.sum("n").alias("w_n"))
    sizes = sizes.join(langs, F.col("lang").eqNullSafe(F.col("l_lang"))).crossJoin(whole)  # one row on the right
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    own, lang, every = F.xxhash64(F.lit("2"), text("lang"), text("source")), F.xxhash64(F.lit("1"), text("lang")), F.xxhash64(F.lit("0"))
    enough, lang_enough = F.col("n") >= least, F.col("l_n") >= least
    feeds = F.array_compact(F.array(F.when(enough, own), F.when(lang_enough & F.col("l_needed"), lang), every))
    judged_by = F.when(enough, own).when(lang_enough, lang).when(F.col("w_n") >= least, every).otherwise(F.lit(0))
    groups = _files.stored(sizes.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), judged_by.alias("grp"), feeds.alias("feeds")).coalesce(1), "groups")
    return Model(groups, groups.count())


def fit(rows: DataFrame, least: int = LEAST) -> Model:
    """Estimates from the statistics of all documents, written before."""
    model = _groups(rows, least)
    used = model.place(rows).where("not q.base_failed").select(F.explode("feeds").alias("grp"), F.col("q.x").alias("x"))
    # the start: cells of 1/64 of each statistic, as many as its range holds
    cells = used.select("grp", F.posexplode("x").alias("k", "value")).groupBy("grp", "k", (F.rint(F.least("value", F.lit(64.0)) * 64) / 64).alias("value")).agg(F.count("*").alias("n"))
    model.estimate = cells.groupBy("grp").applyInPandas(_medians, ESTIMATE)
    x = [F.col("x")[k] for k in range(D)]
    for share in [*[SUBSET] * STEPS, None]:
        measured = model.measure(used).withColumn("bin", F.floor(F.log2(F.col("distance") + 1e-6) * BINS))
        sums = [F.sum(a).alias(f"s{k}") for k, a in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"p{k}") for k, (i, j) in enumerate(PAIRS)]
        estimate = measured.groupBy("grp", "bin").agg(F.count("*").alias("n"), *sums).groupBy("grp").applyInPandas(_concentrate(share), ESTIMATE)
        model.estimate = _files.stored(estimate, "estimate")
    return model


def judged(rows: DataFrame, model: Model, tail: float = TAIL) -> DataFrame:
    """rows with grp, distance (null without an estimate) and kept."""
    cut = chi_square_above(tail, D)
    out = model.measure(model.place(rows).withColumn("x", F.col("q.x")), "left").drop("x", "feeds")
    return out.withColumn("kept", ~F.col("q.base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True)))


def judge(docs: DataFrame, least: int = LEAST, tail: float = TAIL) -> DataFrame:
    """Every document's doc_id, lang, source, counts, distance and verdict."""
    rows = _files.stored(statistics(docs), "statistics")
    return judged(rows, fit(rows, least), tail).select("doc_id", "lang", "source", "q.*", "distance", "kept").drop("x")


def keep(docs: DataFrame, least: int = LEAST, tail: float = TAIL) -> DataFrame:
    """The documents that the rules keep, with all their columns; texts aren't shuffled."""
    model = fit(_files.stored(statistics(docs), "statistics"), least)
    again = docs.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns)], "lang", "source", "text")
    rows = statistics(again, [*(f"_{k}" for k in range(len(docs.columns))), "lang", "source"])
    return judged(rows, model, tail).where("kept").select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept", F.round("distance", 6).alias("distance"))
