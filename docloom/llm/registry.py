"""Queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from docloom.llm import exact_dedup, language_id, line_dedup, mixing, near_dedup, packing, quality_rules, substring_dedup, token_counts, token_files

QUERIES = {
    "op1_near_dedup": near_dedup.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_packing": packing.query,
    "op4_language_id": language_id.query,
    "op5_token_files": token_files.query,
    "op6_token_counts": token_counts.query,
    "op7_line_dedup": line_dedup.query,
    "op8_quality_rules": quality_rules.query,
    "op9_substring_dedup": substring_dedup.query,
    "op10_mixing": mixing.query,
}
SQL = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op8_quality_rules": quality_rules.SQL,
}
