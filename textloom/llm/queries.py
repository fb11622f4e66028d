"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from textloom.llm import codes, context_tree, decontam, language, packing, pii, quality, resampling, sharding, simhash, substring, token_counts, url_rules

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_substring_dedup": substring.op3_substring_dedup,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_lm_scoring": context_tree.op5_lm_scoring,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_sharding": sharding.op7_sharding,
    "op8_url_filters": url_rules.op8_url_filters,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_language_id": language.op10_language_id,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_vector_codes": codes.op12_vector_codes,
    "op13_personal_data": pii.op13_personal_data,
}
ORACLE_SQL = {
    "op1_quality_rules": quality.SQL,
    "op3_substring_dedup": substring.SQL,
    "op4_decontamination": decontam.SQL,
    "op8_url_filters": url_rules.SQL,
    "op11_importance_resampling": resampling.SQL,
    "op12_vector_codes": codes.SQL,
}
