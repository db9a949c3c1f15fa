"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from kinfold.llm import chat_format, embedding_dedup, minhash_dedup, mixing, packing, quality_mil, quality_rules, secret_scan, suffix_dedup, token_files


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.query,
        "op2_quality_rules": quality_rules.query,
        "op3_chat_format": chat_format.query,
        "op4_source_mixing": mixing.query,
        "op5_embedding_dedup": embedding_dedup.query,
        "op6_secret_scan": secret_scan.query,
        "op7_minhash_dedup": minhash_dedup.query,
        "op8_quality_mil": quality_mil.query,
        "op9_token_files": token_files.query,
        "op10_packing": packing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": suffix_dedup.ORACLE,
        "op3_chat_format": chat_format.ORACLE,
        "op5_embedding_dedup": embedding_dedup.ORACLE,
        "op6_secret_scan": secret_scan.ORACLE,
        "op7_minhash_dedup": minhash_dedup.ORACLE,
    }
