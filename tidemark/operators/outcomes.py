"""Outcomes of user functions: ok, dead letter or halt, and the wrapper that records them."""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PANIC, ERROR, DEAD_LETTER = 2, 4, 8


def classify(m: DataFrame) -> DataFrame:
    """status, error and traits from what is known to fail."""
    status = F.when(~F.col("fails"), "ok").when(F.col("dl_fails"), "halt").otherwise("dead_letter")
    error = F.when(F.col("panics"), "panic").when(F.col("fails"), "error")
    traits = F.when(F.col("panics"), PANIC).otherwise(0) + F.when(F.col("fails") & ~F.col("panics"), ERROR).otherwise(0) + F.when(F.col("fails") & ~F.col("dl_fails"), DEAD_LETTER).otherwise(0)
    return m.withColumns({"status": status, "error": error, "traits": traits.cast("long")})


def dead_letters(classified: DataFrame) -> DataFrame:
    return classified.where("status = 'dead_letter'").select("partition", "offset", "key", F.col("error").alias("reason"))


def halted(classified: DataFrame) -> DataFrame:
    """What each partition had processed when the first halt stopped all, and how much it had not."""
    halt = classified.agg(F.min(F.when(F.col("status") == "halt", F.col("offset"))).alias("halt_offset"))
    rows = classified.crossJoin(halt)  # one row on the right
    before = F.col("offset") < F.col("halt_offset")
    return rows.groupBy("partition").agg(F.max(F.when(before, F.col("offset"))).alias("last_offset"), F.count(F.when(F.col("offset") >= F.col("halt_offset"), 1)).alias("n_not_processed"), F.first("halt_offset").alias("halt_offset"))


class Halted(RuntimeError):
    """A dead letter couldn't be written: nothing more may be committed."""


def apply(lanes: DataFrame, process: Callable[[dict], object], dead_letter: Callable[[dict, str], object] | None = None) -> DataFrame:
    """Runs ``process`` on each row of ordered lanes; exceptions go to ``dead_letter``, whose failure is a halt.

    Adds status, error, process_start_us, process_micros and dead_letter_micros.  After a
    halt in a partition its later rows are skipped with status ``halt``, as nothing after it may commit.
    """
    fields = [*lanes.schema.fields, T.StructField("status", T.StringType()), T.StructField("error", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("process_start_us", "process_micros", "dead_letter_micros")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = False
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                if stopped:
                    rows.append(("halt", "skipped", None, None, None))
                    continue
                began, status, error, spent = time.time_ns(), "ok", None, None
                try:
                    process(row)
                    took = time.time_ns()
                except Exception as e:
                    took, status = time.time_ns(), "dead_letter"
                    error = "".join(traceback.format_exception_only(e)).strip()
                    try:
                        if dead_letter:
                            dead_letter(row, error)
                    except Exception as inner:
                        status, stopped, error = "halt", True, f"{error}; dead letter: {inner}"
                    spent = (time.time_ns() - took) // 1000
                rows.append((status, error, began // 1000, (took - began) // 1000, spent))
            extra = pd.DataFrame(rows, columns=["status", "error", "process_start_us", "process_micros", "dead_letter_micros"], index=batch.index).astype({c: "Int64" for c in ("process_start_us", "process_micros", "dead_letter_micros")})
            yield pd.concat([batch, extra], axis=1)

    return lanes.mapInPandas(run, T.StructType(fields))
