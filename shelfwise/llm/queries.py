"""Registered queries and oracle SQL of this subpackage."""

from __future__ import annotations

from shelfwise.llm import (
    exact_dedup,
    nearest_vectors,
    packing,
    periodic_runs,
    piece_nbest,
    quality_rules,
    ranked_search,
    secret_scans,
    simhash_dedup,
    substring_dedup,
    token_output,
    toxicity,
    url_filters,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_simhash_dedup": simhash_dedup.op4_simhash_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_piece_nbest": piece_nbest.op6_piece_nbest,
    "op7_secret_scans": secret_scans.op7_secret_scans,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_packing": packing.op9_packing,
    "op10_token_output": token_output.op10_token_output,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_nearest_vectors": nearest_vectors.op13_nearest_vectors,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.ORACLE_SQL,
    "op2_substring_dedup": substring_dedup.ORACLE_SQL,
    "op8_url_filters": url_filters.ORACLE_SQL,
    "op12_ranked_search": ranked_search.ORACLE_SQL,
}
