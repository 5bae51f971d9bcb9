"""Training-data operators. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tierwise.llm import centroid_clustering, decontamination, embedding_dedup, language_id, license_scan, near_dedup, packing, prefix_trie, quality_rules, secret_scan, substring_dedup, token_counts, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op10_language_id": language_id.op10_language_id,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op7_license_scan": license_scan.op7_license_scan,
        "op9_url_filter": url_filter.op9_url_filter,
        "op4_secret_scan": secret_scan.op4_secret_scan,
        "op5_decontamination": decontamination.op5_decontamination,
        "op2_token_counts": token_counts.op2_token_counts,
        "op11_embedding_dedup": embedding_dedup.op11_embedding_dedup,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_centroid_clustering": centroid_clustering.op13_centroid_clustering,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_license_scan": license_scan.ORACLE,
        "op8_quality_rules": quality_rules.ORACLE,
        "op12_prefix_trie": prefix_trie.ORACLE,
        "op13_centroid_clustering": centroid_clustering.ORACLE,
    }
