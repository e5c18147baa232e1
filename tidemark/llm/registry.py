"""Queries of the corpus operators, one module each."""

from __future__ import annotations

import importlib

#: Modules of this package that register queries, in order.
MODULES = ["q01_html", "q02_decontaminate", "q03_media", "q04_language", "q05_simhash", "q06_packing", "q07_tokens", "q08_quality", "q09_substring", "q10_toxicity", "q11_rules", "q12_spelling", "q13_audit"]


def _modules():
    return [importlib.import_module(f"tidemark.llm.{m}") for m in MODULES]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in getattr(m, "ORACLE_SQL", {}).items()}
