"""Queries of this subpackage for the driver: name -> callable(spark, sf_dir), and their SQL."""

from __future__ import annotations

from shapelake.llm import bpe, chat, exact_dedup, language, mixing, near_dedup, pii, quality, substring_dedup, token_store

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_mixing": mixing.op2_mixing,
    "op3_pii": pii.op3_pii,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_token_store": token_store.op5_token_store,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_chat_format": chat.op7_chat_format,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_language_id": language.op10_language_id,
}
ORACLE_SQL = {
    "op1_quality_rules": quality.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op8_substring_dedup": substring_dedup.OP8_SQL,
}
