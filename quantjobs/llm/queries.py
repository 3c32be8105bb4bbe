"""Registered queries of the llm operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = {
    "op1_url_filter": "url_filter",
    "op2_toxicity": "toxicity",
    "op3_near_dedup": "near_dedup",
    "op4_exact_topk": "topk",
    "op5_secret_scan": "secret_scan",
    "op6_best_fit_packing": "packing",
    "op7_simhash": "simhash",
    "op8_byte_bpe": "byte_bpe",
    "op9_license_scan": "license_scan",
    "op10_pii": "pii",
    "op11_hard_negatives": "hard_negatives",
    "op12_decontaminate": "decontamination",
    "op13_spelling_variants": "spelling",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"quantjobs.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the others are tested against brute force in tests/llm."""
    return {name: import_module(f"quantjobs.llm.{MODULES[name]}").ORACLE_SQL for name in ("op4_exact_topk", "op9_license_scan", "op11_hard_negatives", "op12_decontaminate", "op13_spelling_variants")}
