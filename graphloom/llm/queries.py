"""The registered queries of this subpackage, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from importlib import import_module

_NAMES = {
    "op1_secret_scan": "op01_secrets",
    "op2_line_dedup": "op02_lines",
    "op3_simhash_near_dedup": "op03_simhash",
    "op4_toxicity": "op04_toxicity",
    "op5_main_text": "op05_html",
    "op6_rabitq_neighbours": "op06_rabitq",
    "op7_mix_sources": "op07_mixing",
    "op8_quality": "op08_quality",
    "op9_pack_buckets": "op09_packing",
    "op10_nra_top_k": "op10_nra",
}


def queries() -> dict:
    return {name: import_module(f"graphloom.llm.{module}").query for name, module in _NAMES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"graphloom.llm.{module}"), "SQL", None) for name, module in _NAMES.items()}
    return {name: sql for name, sql in found.items() if sql}
