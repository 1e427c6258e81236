"""Queries of this subpackage, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_lines, op2_decontaminate, op3_quality, op4_substrings, op5_html, op6_packing, op7_chat, op8_urls, op9_suffix_array, op10_jaccard

MODULES = (op1_lines, op2_decontaminate, op3_quality, op4_substrings, op5_html, op6_packing, op7_chat, op8_urls, op9_suffix_array, op10_jaccard)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query opN_<name> for each operator N, over its whole table."""
    return {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for m in MODULES for name in vars(m) if name.startswith("op") and callable(vars(m)[name]) and getattr(m, "SQL", None)}
