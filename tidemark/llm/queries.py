"""The queries and SQL of this subpackage, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat, html_text, licenses, minhash, mixing, neighbours, outliers, packing, repeats, token_files

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = (outliers.op1_quality_rules, token_files.op2_token_files, licenses.op3_license_scan, chat.op4_chat_format, html_text.op5_main_text, neighbours.op6_nearest_neighbours, mixing.op7_mixing, packing.op8_harmonic_packing, minhash.op9_minhash, repeats.op10_repeated_passages)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": chat.SQL, "op7_mixing": mixing.SQL, "op9_minhash": minhash.SQL, "op10_repeated_passages": repeats.SQL}
