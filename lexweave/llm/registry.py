"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from lexweave.llm import (
    bpe,
    chat_format,
    decontaminate,
    html_text,
    jaccard_join,
    line_dedup,
    periodic_runs,
    quality_classifier,
    quality_rules,
    suffix_dedup,
    token_counts,
    top_k_search,
    vector_codes,
)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_html_text": html_text.op2_html_text,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_bpe": bpe.op9_bpe,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_top_k_search": top_k_search.op11_top_k_search,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    "token_counts_warm": token_counts.token_counts_warm,
}
SQL = {"op8_quality_rules": quality_rules.OP8_SQL, "op11_top_k_search": top_k_search.OP11_SQL, "op12_vector_codes": vector_codes.OP12_SQL}
