"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from lintlake.llm import ann, chat, exact_dedup, filter_audit, license_scan, lm_scoring, mixing, near_dedup, packing, periodic_runs, quality, token_counts, toxicity

QUERIES = {
    "op1_lm_scoring": lm_scoring.query,
    "op2_token_counts": token_counts.query,
    "op3_packing": packing.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_nearest_neighbours": ann.query,
    "op6_license_scan": license_scan.query,
    "op7_quality_classifier": quality.query,
    "op8_chat_formatting": chat.query,
    "op9_near_dedup": near_dedup.query,
    "op10_mixing": mixing.query,
    "op11_filter_audit": filter_audit.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_toxicity": toxicity.query,
    "license_scan_variants": license_scan.variants_query,
}
ORACLES = {
    "op4_exact_dedup": exact_dedup.SQL,
    "op6_license_scan": license_scan.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "license_scan_variants": license_scan.VARIANTS_SQL,
}
