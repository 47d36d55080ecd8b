"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, exact_dedup, html_extract, line_dedup, mixing, quality, simhash, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": html_extract.op1,
    "op2_simhash_near_dedup": simhash.op2,
    "op3_chat_formatting": chat_format.op3,
    "op4_toxicity": toxicity.op4,
    "op5_source_mixing": mixing.op5,
    "op6_line_dedup": line_dedup.op6,
    "op7_token_counts": token_counts.op7,
    "op8_benchmark_decontamination": decontaminate.op8,
    "op9_exact_dedup": exact_dedup.op9,
    "op10_quality_classifier": quality.op10,
    "chat_typed_parts": chat_format.typed_parts,
}

#: The others can't be told in SQL; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "chat_typed_parts": chat_format.SQL,
    "op5_source_mixing": mixing.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
}
