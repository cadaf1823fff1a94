"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontamination, exact_dedup, line_dedup, mixing, piece_bpe, preference_format, quality_classifier, quality_rules, simhash, suffix_tree_lm, token_counts, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_preference_format": preference_format.op2_preference_format,
        "op3_robust_outliers": quality_rules.op3_robust_outliers,
        "op4_compression_quality": quality_classifier.op4_compression_quality,
        "op5_poisson_mix": mixing.op5_poisson_mix,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_piece_dropout": piece_bpe.op8_piece_dropout,
        "op9_simhash": simhash.op9_simhash,
        "op10_suffix_tree_score": suffix_tree_lm.op10_suffix_tree_score,
        "op11_phrases": collocations.op11_phrases,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_decontamination": decontamination.op13_decontamination,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op2_preference_format": preference_format.OP2_SQL,
        "op5_poisson_mix": mixing.OP5_SQL,
        "op6_line_dedup": line_dedup.OP6_SQL,
        "op11_phrases": collocations.OP11_SQL,
        "op12_vector_codes": vector_codes.OP12_SQL,
        "op13_decontamination": decontamination.OP13_SQL,
    }
