"""The queries of this subpackage and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from . import exact_dedup, gru_lm, hnsw_dedup, jaccard_join, licenses, mixing, pieces, quality_crf, secrets, token_store

QUERIES = {
    "op1_hnsw_dedup": hnsw_dedup.op1_hnsw_dedup,
    "op2_quality": quality_crf.op2_quality,
    "op3_secrets": secrets.op3_secrets,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_gru_lm": gru_lm.op7_gru_lm,
    "op8_token_store": token_store.op8_token_store,
    "op9_mixing": mixing.op9_mixing,
    "op10_licenses": licenses.op10_licenses,
}

ORACLES = {
    "op1_hnsw_dedup": hnsw_dedup.ORACLE,
    "op3_secrets": secrets.ORACLE,
    "op4_jaccard_join": jaccard_join.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op9_mixing": mixing.ORACLE,
}
