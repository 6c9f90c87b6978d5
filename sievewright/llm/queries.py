"""The queries of this subpackage and the SQL that states them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat, cotraining, exact_dedup, language_id, licenses, minhash, mixing, packing, quality_rules, ranked, repair, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": minhash.op1_minhash,
    "op2_cotraining": cotraining.op2_cotraining,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_licenses": licenses.op5_licenses,
    "op6_chat_perspectives": chat.op6_chat_perspectives,
    "op7_language_id": language_id.op7_language_id,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_mixing": mixing.op9_mixing,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_structure_repair": repair.op11_structure_repair,
    "op12_packing": packing.op12_packing,
    "op13_ranked_search": ranked.op13_ranked_search,
}

ORACLE_SQL: dict[str, str] = {
    "op5_licenses": licenses.OP5_SQL,
    "op6_chat_perspectives": chat.OP6_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_structure_repair": repair.OP11_SQL,
    "op13_ranked_search": ranked.OP13_SQL,
}
