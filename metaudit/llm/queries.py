"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import centroids, chat_format, decontaminate, exact_dedup, language_model, mixing, near_dedup, odd_sketch, pii, prefix_trie, quality, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_simhash": near_dedup.query,
    "op3_pii": pii.query,
    "op4_language_model": language_model.query,
    "op5_quality": quality.query,
    "op6_mix_sources": mixing.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_url_filter": url_filter.query,
    "op9_chat_format": chat_format.query,
    "op10_decontaminate": decontaminate.query,
    "op11_centroids": centroids.query,
    "op12_odd_sketch": odd_sketch.query,
    "op13_prefix_trie": prefix_trie.query,
}
ORACLES = {
    "op6_mix_sources": mixing.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op9_chat_format": chat_format.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
    "op11_centroids": centroids.ORACLE,
    "op12_odd_sketch": odd_sketch.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
