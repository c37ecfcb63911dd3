"""The registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import divergence, fingerprints, html_extraction, jaccard_join, mixing, packing, quality, resharding, secrets, suffix_dedup, token_counts, url_filters, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_mixing": mixing.op4_mixing,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_main_text": html_extraction.op7_main_text,
    "op8_consistent_sampling": fingerprints.op8_consistent_sampling,
    "op9_url_range_join": url_filters.op9_url_range_join,
    "op10_min_cost_resharding": resharding.op10_min_cost_resharding,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_divergence": divergence.op13_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": secrets.OP1_SQL,
    "op5_quality_rules": quality.OP5_SQL,
    "op9_url_range_join": url_filters.OP9_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op12_suffix_dedup": suffix_dedup.OP12_SQL,
    "op13_divergence": divergence.OP13_SQL,
}
