"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, html_text, language_id, lm_scoring, neighbours, ngram_join, packing, secrets, token_counts


def queries():
    return {
        "op1_vptree_neighbours": neighbours.op1_vptree_neighbours,
        "op1_vptree_neighbours_exact": neighbours.op1_vptree_neighbours_exact,
        "op2_masked_lm_scoring": lm_scoring.op2_masked_lm_scoring,
        "op3_chat_formatting": chat.op3_chat_formatting,
        "op3_chat_changes": chat.op3_chat_changes,
        "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_secret_scan": secrets.op6_secret_scan,
        "op7_bucket_packing": packing.op7_bucket_packing,
        "op8_html_extraction": html_text.op8_html_extraction,
        "op9_language_id": language_id.op9_language_id,
        "op10_ngram_jaccard_join": ngram_join.op10_ngram_jaccard_join,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op1_vptree_neighbours_exact": neighbours.ORACLE_EXACT,
        "op3_chat_formatting": chat.ORACLE,
        "op3_chat_changes": chat.ORACLE_CHANGES,
        "op7_bucket_packing": packing.oracle(),
        "op10_ngram_jaccard_join": ngram_join.ORACLE,
    }
