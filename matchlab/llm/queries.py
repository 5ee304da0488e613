"""Queries of the operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from . import (
    audit_query,
    chat_query,
    learn_queries,
    page_query,
    runs_query,
    search_query,
    secrets_query,
    simhash_query,
    text_queries,
    token_query,
)

QUERIES = {
    "op1_chat_format": chat_query.op1_chat_format,
    "op2_decontaminate": text_queries.op2_decontaminate,
    "op3_near_duplicates": text_queries.op3_near_duplicates,
    "op4_token_counts": token_query.op4_token_counts,
    "op5_simhash": simhash_query.op5_simhash,
    "op6_secrets": secrets_query.op6_secrets,
    "op7_main_text": page_query.op7_main_text,
    "op8_language_id": learn_queries.op8_language_id,
    "op9_toxicity": learn_queries.op9_toxicity,
    "op10_sentencepiece": learn_queries.op10_sentencepiece,
    "op11_filter_audit": audit_query.op11_filter_audit,
    "op12_top_k": search_query.op12_top_k,
    "op13_word_runs": runs_query.op13_word_runs,
}
ORACLE = {
    "op1_chat_format": chat_query.SQL,
    "op2_decontaminate": text_queries.DECONTAMINATE_SQL,
    "op3_near_duplicates": text_queries.NEAR_SQL,
    "op11_filter_audit": audit_query.SQL,
    "op12_top_k": search_query.SQL,
    "op13_word_runs": runs_query.SQL,
}
