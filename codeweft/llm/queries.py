"""Registered queries of this package: name -> (query, DuckDB SQL or None)."""
from __future__ import annotations

from . import (decontaminate, html, importance, neardup, pieces, pii, quality, runs, scoring, secrets, sharding,
               substrings, urls)

# Where SQL is None, tests/llm holds the query against a brute-force version.
QUERIES = {
    "op1_pii_surrogates": (pii.op1, None),
    "op2_minhash_neardup": (neardup.op2, None),
    "op3_substring_dedup": (substrings.op3, None),
    "op4_secret_ownership": (secrets.op4, secrets.OP4_SQL),
    "op5_line_first_quality": (quality.op5, None),
    "op6_sentencepiece": (pieces.op6, None),
    "op7_benchmark_containment": (decontaminate.op7, decontaminate.OP7_SQL),
    "op8_html_main_text": (html.op8, None),
    "op9_backoff_scoring": (scoring.op9, None),
    "op10_hypergeometric_shards": (sharding.op10, None),
    "op11_periodic_runs": (runs.op11, None),
    "op12_url_filter": (urls.op12, None),
    "op13_importance_resampling": (importance.op13, importance.OP13_SQL),
}
