"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from quire.llm import chat_format, conversation_repair, embedding_dedup, exact_dedup, lattice_score, ngram_join, packing, pieces, quality, secret_scan, suffix_dedup, target_sampling, url_filter

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_ngram_jaccard": ngram_join.op9_ngram_jaccard,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_target_resampling": target_sampling.op11_target_resampling,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_lattice_score": lattice_score.op13_lattice_score,
}
ORACLES = {
    "op7_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op1_chat_format": chat_format.ORACLE_SQL,
    "op2_url_filter": url_filter.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_target_resampling": target_sampling.ORACLE_SQL,
    "op12_conversation_repair": conversation_repair.ORACLE_SQL,
}
