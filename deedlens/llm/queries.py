"""Queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from .bpe import op9_byte_bpe
from .centroids import OP12_SQL, op12_centroid_clustering
from .html_main import op1_html_extraction
from .language import op11_language_id
from .merkle import OP6_SQL, op6_document_fingerprints
from .minhash import op10_minhash_near_dedup
from .ogg import op7_media_columns
from .packing import op5_best_fit_packing
from .quality import op8_quality_classifier
from .suffix_dedup import op2_suffix_dedup
from .toxicity import op3_toxicity
from .url_rules import OP4_SQL, op4_url_filter

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_media_columns": op7_media_columns,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_language_id": op11_language_id,
    "op12_centroid_clustering": op12_centroid_clustering,
}

SQL = {
    "op4_url_filter": OP4_SQL,
    "op6_document_fingerprints": OP6_SQL,
    "op12_centroid_clustering": OP12_SQL,
}
