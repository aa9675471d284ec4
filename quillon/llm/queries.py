"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from quillon.llm import centroids, decontaminate, embeddings, langid, linededup, mixing, negatives, ngramjoin, substrings, tokens, toxicity, urlfilter, warc

QUERIES = {
    "op1_ngram_jaccard_join": ngramjoin.query,
    "op2_token_output": tokens.query,
    "op3_warc": warc.query,
    "op4_embedding_near_dedup": embeddings.query,
    "op5_url_filters": urlfilter.query,
    "op6_source_mixing": mixing.query,
    "op7_language_id": langid.query,
    "op8_line_dedup": linededup.query,
    "op9_substring_dedup": substrings.query,
    "op10_benchmark_decontamination": decontaminate.query,
    "op11_centroid_clustering": centroids.query,
    "op12_hard_negatives": negatives.query,
    "op13_toxicity": toxicity.query,
}

ORACLES = {
    "op1_ngram_jaccard_join": ngramjoin.SQL,
    "op3_warc": warc.SQL,
    "op5_url_filters": urlfilter.SQL,
    "op8_line_dedup": linededup.SQL,
    "op9_substring_dedup": substrings.SQL,
    "op10_benchmark_decontamination": decontaminate.SQL,
    "op11_centroid_clustering": centroids.SQL,
    "op12_hard_negatives": negatives.SQL,
}
