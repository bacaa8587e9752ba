"""The queries of the corpus operators and their oracles."""

from __future__ import annotations

from . import context_tree, decontaminate, fingerprints, licenses, line_dedup, mixing, ngram_join, oracles, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_fingerprints": fingerprints.query,
    "op2_context_tree": context_tree.query,
    "op3_decontaminate": decontaminate.query,
    "op4_ngram_jaccard": ngram_join.query,
    "op5_licenses": licenses.query,
    "op6_mixing": mixing.query,
    "op7_substring_dedup": substring_dedup.query,
    "op8_toxicity": toxicity.query,
    "op9_line_dedup": line_dedup.query,
    "op10_url_filter": url_filter.query,
}
#: The others can't be put in SQL as a whole (hashed sketches, trees, models,
#: seeded draws); tests/llm holds each against brute force.
ORACLES: dict[str, str] = {
    "op4_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op5_licenses": oracles.LICENSES,
    "op7_substring_dedup": oracles.SUBSTRING_DEDUP,
}
