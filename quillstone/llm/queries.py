"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from . import embedding_dedup, fuzzy_dedup, licences, line_dedup, media, mixing, near_dedup, packing, quality, suffix_dedup

QUERIES = {
    "op1_suffix_array_dedup": suffix_dedup.op1,
    "op2_substring_dedup": fuzzy_dedup.op2,
    "op3_license_scan": licences.op3,
    "op4_embedding_near_dedup": embedding_dedup.op4,
    "op5_source_mixing": mixing.op5,
    "op6_media_columns": media.op6,
    "op7_line_dedup": line_dedup.op7,
    "op8_packing": packing.op8,
    "op9_quality_classifier": quality.op9,
    "op10_minhash_near_dedup": near_dedup.op10,
}

SQL = {
    "op1_suffix_array_dedup": suffix_dedup.SQL,
    "op4_embedding_near_dedup": embedding_dedup.SQL,
    "op6_media_columns": media.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op8_packing": packing.SQL,
}
