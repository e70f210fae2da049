"""Queries and SQL of the operators of this subpackage."""

from __future__ import annotations

from granary.llm import html_extract, jaccard_join, license_scan, line_templates, lm_score, lsa_decontaminate, packing, quality_pu, suffix_dedup, topk_search

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_lm_score": lm_score.query,
    "op3_line_templates": line_templates.query,
    "op4_license_scan": license_scan.query,
    "op5_lsa_decontaminate": lsa_decontaminate.query,
    "op6_quality_pu": quality_pu.query,
    "op7_topk_search": topk_search.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_html_extract": html_extract.query,
    "op10_best_fit_packing": packing.query,
}
ORACLES = {
    "op1_suffix_dedup": suffix_dedup.ORACLE,
    "op2_lm_score": lm_score.ORACLE,
    "op7_topk_search": topk_search.ORACLE,
    "op8_jaccard_join": jaccard_join.ORACLE,
}
