"""Queries of this package by name.

Those without SQL hold something that DuckDB can't compute from the tables (hashes over
graph components, trained models, tokenizers), so tests/llm compares each with a brute-force
version, an exact round trip or held-out rows instead.
"""

from __future__ import annotations

from llm import (
    op1_ngram_jaccard,
    op2_pii,
    op3_language_id,
    op4_substring_dedup,
    op5_decontamination,
    op6_repetition,
    op7_byte_bpe,
    op8_toxicity,
    op9_token_files,
    op10_secrets,
    op11_piece_ids,
    op12_zorder_layout,
    op13_divergence,
)

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard.query,
    "op2_pii": op2_pii.query,
    "op3_language_id": op3_language_id.query,
    "op4_substring_dedup": op4_substring_dedup.query,
    "op5_decontamination": op5_decontamination.query,
    "op6_repetition": op6_repetition.query,
    "op7_byte_bpe": op7_byte_bpe.query,
    "op8_toxicity": op8_toxicity.query,
    "op9_token_files": op9_token_files.query,
    "op10_secrets": op10_secrets.query,
    "op11_piece_ids": op11_piece_ids.query,
    "op12_zorder_layout": op12_zorder_layout.query,
    "op13_divergence": op13_divergence.query,
}

ORACLE_SQL = {
    "op12_zorder_layout": op12_zorder_layout.sql(),
    "op13_divergence": op13_divergence.SQL,
}
