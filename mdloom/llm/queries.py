"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from mdloom.llm import (decontaminate, divergence, embedding_dedup, fingerprints, hmm_lm, language_id, mixing, ngram_join, packing, prefix_trie, secrets,
                        suffix_dedup, token_files)

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.q_op1,
    "op2_source_mixing": mixing.q_op2,
    "op3_secret_scan": secrets.q_op3,
    "op4_hmm_scores": hmm_lm.q_op4,
    "op5_token_files": token_files.q_op5,
    "op6_language_id": language_id.q_op6,
    "op7_fingerprints": fingerprints.q_op7,
    "op8_packing": packing.q_op8,
    "op9_embedding_dedup": embedding_dedup.q_op9,
    "op10_ngram_join": ngram_join.q_op10,
    "op11_decontamination": decontaminate.q_op11,
    "op12_prefix_trie": prefix_trie.q_op12,
    "op13_source_divergence": divergence.q_op13,
}
#: The other operators hold seeded, trained or encoded results that SQL cannot express; tests/llm compares them with brute force.
ORACLES = {"op1_suffix_dedup": suffix_dedup.ORACLE, "op10_ngram_join": ngram_join.ORACLE, "op11_decontamination": decontaminate.ORACLE,
           "op12_prefix_trie": prefix_trie.ORACLE, "op13_source_divergence": divergence.ORACLE}
