"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query -> module; a module's ORACLE_SQL, if any, belongs to its query.
MODULES = {
    "op1_permutation_ann": "permutation",
    "op2_line_dedup": "lines",
    "op3_impact_topk": "impact",
    "op4_language_id": "langid",
    "op5_lm_scoring": "lm",
    "op6_mix_sources": "mix",
    "op7_best_fit_packing": "pack",
    "op8_sharding": "shard",
    "op9_simhash": "simhash",
    "op10_license_scan": "license",
    "op11_vector_codes": "codebooks",
    "op12_spelling_groups": "spelling",
    "op13_token_counts": "counts",
}


def queries() -> dict:
    return {q: getattr(import_module(f"ragframe.llm.{m}"), q) for q, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {q: getattr(import_module(f"ragframe.llm.{m}"), "ORACLE_SQL", None) for q, m in MODULES.items()}
    return {q: sql for q, sql in found.items() if sql}
