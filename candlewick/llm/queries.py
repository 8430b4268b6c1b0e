"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from candlewick.llm import chat_format, decontam, jaccard_join, license_scan, line_dedup, packing, pii, quality_rules, toxicity, url_filter

QUERIES = {
    "op1_viterbi": chat_format.op1_viterbi,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_digest_array": url_filter.op3_digest_array,
    "op4_anchor_expansion": pii.op4_anchor_expansion,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_winnowing": decontam.op6_winnowing,
    "op7_token_group": jaccard_join.op7_token_group,
    "op8_line_hashing": line_dedup.op8_line_hashing,
    "op9_diagonal_voting": license_scan.op9_diagonal_voting,
    "op10_ftrl": toxicity.op10_ftrl,
}
ORACLES = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op3_digest_array": url_filter.ORACLE,
    "op6_winnowing": decontam.ORACLE,
    "op8_line_hashing": line_dedup.ORACLE,
    "op9_diagonal_voting": license_scan.ORACLE,
}
