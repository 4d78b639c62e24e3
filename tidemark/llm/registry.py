"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import byte_dedup, decontaminate, line_dedup, mixing, ngram_join, phrases, pii, quality_rules, secret_scan, sentence_pieces, source_divergence, substring_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.query,
        "op2_secret_scan": secret_scan.query,
        "op3_ngram_join": ngram_join.query,
        "op4_suffix_array_dedup": byte_dedup.query,
        "op5_pii": pii.query,
        "op6_mixing": mixing.query,
        "op7_line_dedup": line_dedup.query,
        "op8_toxicity": toxicity.query,
        "op9_substring_dedup": substring_dedup.query,
        "op10_decontamination": decontaminate.query,
        "op11_phrase_collocations": phrases.query,
        "op12_source_divergence": source_divergence.query,
        "op13_sentence_pieces": sentence_pieces.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": ngram_join.ORACLE, "op4_suffix_array_dedup": byte_dedup.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "op9_substring_dedup": substring_dedup.ORACLE, "op11_phrase_collocations": phrases.ORACLE, "op12_source_divergence": source_divergence.ORACLE}
