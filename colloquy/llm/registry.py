"""Registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import (
    bpe,
    centroids,
    exact_dedup,
    html_text,
    language,
    lm_score,
    packing,
    quality,
    rank_bpe,
    ranked_search,
    simhash,
    suffix_dedup,
    vectors,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_repeated_windows": suffix_dedup.op1_repeated_windows,
        "op2_near_vectors": vectors.op2_near_vectors,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_language": language.op4_language,
        "op5_quality": quality.op5_quality,
        "op6_simhash": simhash.op6_simhash,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_main_text": html_text.op8_main_text,
        "op9_bpe_round_trip": bpe.op9_bpe_round_trip,
        "op10_cross_entropy_difference": lm_score.op10_cross_entropy_difference,
        "op11_ranked_search": ranked_search.op11_ranked_search,
        "op12_centroids": centroids.op12_centroids,
        "op13_rank_bpe_round_trip": rank_bpe.op13_rank_bpe_round_trip,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": exact_dedup.ORACLE,
        "op11_ranked_search": ranked_search.ORACLE,
        "op12_centroids": centroids.ORACLE,
    }
