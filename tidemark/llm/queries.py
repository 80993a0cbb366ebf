"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import chat, exact_dedup, merge_dropout, merkle, mixing, pii, secret_scan, simhash, substring, toxicity


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_simhash_anchors": simhash.op2_simhash_anchors,
        "op3_repeated_passages": substring.op3_repeated_passages,
        "op4_merge_dropout": merge_dropout.op4_merge_dropout,
        "op5_surrogates": pii.op5_surrogates,
        "op6_markov_secrets": secret_scan.op6_markov_secrets,
        "op7_mix_sources": mixing.op7_mix_sources,
        "op8_merkle_fingerprints": merkle.op8_merkle_fingerprints,
        "op9_ordinal_toxicity": toxicity.op9_ordinal_toxicity,
        "op10_chat_format": chat.op10_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE,
        "op3_repeated_passages": substring.ORACLE,
        "op7_mix_sources": mixing.ORACLE,
        "op10_chat_format": chat.ORACLE,
    }
