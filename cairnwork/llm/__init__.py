"""Operators for training-data pipelines; nothing else in the library imports this subpackage."""

from __future__ import annotations

from . import op1_secrets, op2_suffix, op3_mixing, op4_sentencepiece, op5_quality, op6_substring, op7_media, op8_jaccard, op9_tokens, op10_hashing

_MODULES = (op1_secrets, op2_suffix, op3_mixing, op4_sentencepiece, op5_quality, op6_substring, op7_media, op8_jaccard, op9_tokens, op10_hashing)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
