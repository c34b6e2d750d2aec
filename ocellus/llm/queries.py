"""The corpus queries and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ocellus.llm import audit, chat, decontaminate, langid, lm, near_dup, oracles, packing, quality, rules, secrets, substrings, suffix_dedup, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_secret_scans": secrets.op2_secret_scans,
    "op3_suffix_array_dedup": suffix_dedup.op3_suffix_array_dedup,
    "op4_harmonic_packing": packing.op4_harmonic_packing,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_quality_rules": rules.op7_quality_rules,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_minhash_near_dedup": near_dup.op9_minhash_near_dedup,
    "op10_language_id": langid.op10_language_id,
    "op11_vector_code_compression": vector_codes.op11_vector_code_compression,
    "op12_lm_scoring": lm.op12_lm_scoring,
    "op13_filter_interaction_audit": audit.op13_filter_interaction_audit,
}
#: The others' models and tokenizers cannot be put in SQL.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op3_suffix_array_dedup": oracles.SUFFIX_ARRAY_DEDUP,
    "op5_benchmark_decontamination": oracles.BENCHMARK_DECONTAMINATION,
    "op6_chat_formatting": chat.OP6_SQL,
    "op9_minhash_near_dedup": oracles.NEAR_DEDUP,
    "op11_vector_code_compression": vector_codes.SQL,
    "op13_filter_interaction_audit": audit.SQL,
}
