"""The queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontamination, fingerprints, line_dedup, mixing, ngram_join, quality, sharding, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_ngram_jaccard": ngram_join.op5_ngram_jaccard,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_benchmark_decontamination": decontamination.op7_benchmark_decontamination,
    "op8_sharding": sharding.op8_sharding,
    "op9_chat_formatting": conversations.op9_chat_formatting,
    "op10_document_fingerprints": fingerprints.op10_document_fingerprints,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op5_ngram_jaccard": ngram_join.ORACLE_SQL,
    "op7_benchmark_decontamination": decontamination.ORACLE_SQL,
    "op8_sharding": sharding.ORACLE_SQL,
    "op9_chat_formatting": conversations.ORACLE_SQL,
}
