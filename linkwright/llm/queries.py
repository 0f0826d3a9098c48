"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op7_bpe_encode_decode
from .cws import op9_cws_fingerprints
from .html import op2_html_extraction
from .lm import op3_lm_scoring
from .media import op6_media_columns
from .packing import op10_best_fit_packing
from .pii import op8_pii
from .quality import op5_quality_classifier
from .simhash import op4_simhash_near_dedup
from .substring import op1_substring_dedup

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_media_columns": op6_media_columns,
    "op7_bpe_encode_decode": op7_bpe_encode_decode,
    "op8_pii": op8_pii,
    "op9_cws_fingerprints": op9_cws_fingerprints,
    "op10_best_fit_packing": op10_best_fit_packing,
}

#: None of the ten can be told in DuckDB's SQL on whole tables; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {}
