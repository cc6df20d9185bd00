"""The queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from docloom.llm import chat, embedding_dedup, hard_negatives, jaccard_join, langid, mixing, packing, pieces, quality, secrets, suffix_dedup, url_filters, whitening

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_secret_scans": secrets.op7_secret_scans,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_language_id": langid.op9_language_id,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_packing": packing.op11_packing,
    "op12_whitening": whitening.op12_whitening,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLES = {"op1_url_filters": url_filters.op1_sql(), "op6_mixing": mixing.op6_sql(), "op8_chat_formatting": chat.OP8_SQL}
