"""Prefix computations over ordered groups that may be too large for one task.

A plain window over (group order by position) sorts a whole group in one task.  Here a
group is cut into blocks of its position; each block is scanned alone, and what comes
before a block is added from a table of block totals (one row a group and block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 1 << 20


def blocks(position: str | Column, size: int = BLOCK) -> Column:
    return F.floor((F.col(position) if isinstance(position, str) else position) / F.lit(size)).cast("long")


def prefix(df: DataFrame, group: list[str], order: list[str], block: Column, **what: tuple[str, Column]) -> DataFrame:
    """df with a column for each of ``what``: name=(kind, value).

    Kinds: ``sum``, ``max`` and ``min`` up to and with the row; ``sum_before`` and ``max_before`` without
    it; ``last_before``, the value of the row before.  ``block`` must not decrease along ``order``.
    """
    df = df.withColumn("_block", block)
    inside = W.partitionBy(*group, "_block").orderBy(*order)
    upto, before = inside.rowsBetween(W.unboundedPreceding, 0), inside.rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    own, totals, carried, out = {}, [], {}, {}
    for name, (kind, value) in what.items():
        base = kind.split("_")[0]
        if base == "last":
            own[f"_{name}"] = F.lag(value).over(inside)
            totals.append(F.max_by(value, F.struct(*order)).alias(f"_t_{name}"))
            carried[f"_c_{name}"] = F.last(f"_t_{name}", ignorenulls=True).over(earlier)
            out[name] = F.coalesce(f"_{name}", f"_c_{name}")
            continue
        f = {"sum": F.sum, "max": F.max, "min": F.min}[base]
        own[f"_{name}"] = f(value).over(before if kind.endswith("_before") else upto)
        totals.append(f(value).alias(f"_t_{name}"))
        carried[f"_c_{name}"] = f(f"_t_{name}").over(earlier)
        if base == "sum":
            out[name] = F.coalesce(f"_{name}", F.lit(0)) + F.coalesce(f"_c_{name}", F.lit(0))
        else:
            out[name] = {"max": F.greatest, "min": F.least}[base](f"_{name}", f"_c_{name}")
    sums = df.groupBy(*group, "_block").agg(*totals).withColumns(carried).select(*group, "_block", *carried)
    return df.withColumns(own).join(sums, [*group, "_block"]).withColumns(out).drop("_block", *own, *carried)


def queued(df: DataFrame, group: list[str], order: list[str], block: Column, arrives: Column, takes: Column) -> DataFrame:
    """df with _finish: when each row of a group, served one after another in order, is done.

    That is C + max(arrives - C before) over the rows up to this one, C being the running sum of takes.  Both
    running values come from one pass over a block, and of a block's totals the sum shifts the maxima after it.
    """
    upto = W.partitionBy(*group, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_block", block).withColumn("_takes", takes).withColumn("_s", F.sum("_takes").over(upto))
    df = df.withColumn("_m", F.max(arrives - F.col("_s") + F.col("_takes")).over(upto))
    totals = df.groupBy(*group, "_block").agg(F.sum("_takes").alias("_t"), F.max("_m").alias("_most"))
    totals = totals.withColumn("_c", F.coalesce(F.sum("_t").over(earlier), F.lit(0)))
    totals = totals.withColumn("_e", F.max(F.col("_most") - F.col("_c")).over(earlier)).drop("_t", "_most")
    finish = F.col("_c") + F.col("_s") + F.greatest("_e", F.col("_m") - F.col("_c"))
    return df.join(totals, [*group, "_block"]).withColumn("_finish", finish).drop("_block", "_takes", "_s", "_m", "_c", "_e")
