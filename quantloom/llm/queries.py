"""Registered queries of the operators, and DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from . import chat, hard_negatives, media, merkle, mixing, near_duplicates, packing, pii, quality, rules, substrings, token_counts, toxicity

QUERIES = {
    "op1_media": media.op1_media,
    "op2_quality": quality.op2_quality,
    "op3_packing": packing.op3_packing,
    "op4_substrings": substrings.op4_substrings,
    "op5_jaccard": near_duplicates.op5_jaccard,
    "op6_pii": pii.op6_pii,
    "op7_mixing": mixing.op7_mix,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality_rules": rules.op9_rules,
    "op10_chat": chat.op10_chat,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_merkle": merkle.op12_merkle,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE_SQL = {
    "op7_mixing": mixing.OP7_SQL,
    "op12_merkle": merkle.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
