"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from . import decontaminate, linededup, lm, neighbours, ngram_join, packing, sharding, substring, tokens, toxicity

QUERIES = {
    "op1_nearest_neighbours": neighbours.op1_nearest_neighbours,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_substring_dedup": substring.op6_substring_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op8_lm_scores": lm.op8_lm_scores,
    "op9_token_counts": tokens.op9_token_counts,
    "op10_packing": packing.op10_packing,
}

ORACLES = {
    "op2_line_dedup": linededup.ORACLE,
    "op4_ngram_join": ngram_join.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op6_substring_dedup": substring.ORACLE,
}
