"""Queries of the training-data operators, by name."""

from __future__ import annotations

from . import decontaminate, language, line_dedup, near_dedup, packing, quality, sharding, suffix_dedup, token_counts, toxicity

_QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_best_fit_packing": packing.query,
    "op3_quality_rules": quality.query,
    "op4_near_dedup": near_dedup.query,
    "op5_suffix_dedup": suffix_dedup.query,
    "op6_sharding": sharding.query,
    "op7_line_dedup": line_dedup.query,
    "op8_language_id": language.query,
    "op9_decontamination": decontaminate.query,
    "op10_token_counts": token_counts.query,
}
_SQL: dict[str, str] = {
    "op3_quality_rules": quality.SQL,
    "op7_line_dedup": line_dedup.SQL,
}


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
