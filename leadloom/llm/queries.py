"""Queries of this package: one for each operator, over whole tables."""

from __future__ import annotations

from leadloom.llm import chat, divergence, exact_dedup, fingerprints, jaccard, language, mixing, pieces, secrets, spelling, substrings, token_counts, toxicity

QUERIES = {
    "op1_language_id": language.op1,
    "op2_substring_dedup": substrings.op2,
    "op3_token_counts": token_counts.op3,
    "op4_secret_scans": secrets.op4,
    "op5_mixing": mixing.op5,
    "op6_sentencepiece": pieces.op6,
    "op7_fingerprints": fingerprints.op7,
    "op8_jaccard_join": jaccard.op8,
    "op9_toxicity": toxicity.op9,
    "op10_exact_dedup": exact_dedup.op10,
    "op11_source_divergence": divergence.op11,
    "op12_spelling_variants": spelling.op12,
    "op13_chat_format": chat.op13,
}

ORACLE = {
    "op2_substring_dedup": substrings.OP2_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op8_jaccard_join": jaccard.OP8_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
}
