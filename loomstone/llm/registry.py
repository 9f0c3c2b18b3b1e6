"""The queries of this subpackage, for the driver's entry file. Importing this imports every operator, so what lacks shows here."""

from __future__ import annotations

from loomstone.llm import (
    op1_minhash,
    op2_mixing,
    op3_language_id,
    op4_packing,
    op5_ann,
    op6_substring_dedup,
    op7_quality_rules,
    op8_chat_format,
    op9_quality_classifier,
    op10_warc,
)

OPERATORS = (op1_minhash, op2_mixing, op3_language_id, op4_packing, op5_ann, op6_substring_dedup, op7_quality_rules, op8_chat_format, op9_quality_classifier, op10_warc)


def queries() -> dict:
    return {name: q for m in OPERATORS for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in OPERATORS for name, sql in m.ORACLE_SQL.items()}
