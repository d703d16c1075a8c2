"""The corpus operators' queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import chat, decontaminate, exact_dedup, fill_in_middle, fingerprints, hard_negatives, language_model, mixing, simhash, substring_dedup, token_counts, token_store, toxicity

_OPERATORS = {
    "op1_substring_dedup": substring_dedup,
    "op2_toxicity": toxicity,
    "op3_token_store": token_store,
    "op4_language_model": language_model,
    "op5_token_counts": token_counts,
    "op6_mixing": mixing,
    "op7_simhash": simhash,
    "op8_exact_dedup": exact_dedup,
    "op9_chat_formatting": chat,
    "op10_decontamination": decontaminate,
    "op11_fingerprints": fingerprints,
    "op12_hard_negatives": hard_negatives,
    "op13_fill_in_middle": fill_in_middle,
}

QUERIES = {name: module.query for name, module in _OPERATORS.items()}
ORACLES = {name: module.ORACLE for name, module in _OPERATORS.items() if module.ORACLE}
