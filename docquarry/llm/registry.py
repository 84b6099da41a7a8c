"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_url_filter": "url_filter",
    "op2_pii": "pii",
    "op3_lm_score": "lm_score",
    "op4_jaccard_join": "jaccard_join",
    "op5_substring_index": "substring_index",
    "op6_suffix_dedup": "suffix_dedup",
    "op7_decontaminate": "decontaminate",
    "op8_mixing": "mixing",
    "op9_fertility": "fertility",
    "op10_token_counts": "token_counts",
}

QUERIES = {name: importlib.import_module(f"docquarry.llm.{module}").query for name, module in _MODULES.items()}
ORACLES: dict[str, str] = {name: oracle for name, module in _MODULES.items() if (oracle := getattr(importlib.import_module(f"docquarry.llm.{module}"), "ORACLE", None))}
