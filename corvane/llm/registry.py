"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontam, langid, licenses, mixing, ngram_join, pii, quality, secrets, sstable, substrings


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_benchmark_decontamination": decontam.op1_benchmark_decontamination,
        "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
        "op3_secret_scan": secrets.op3_secret_scan,
        "op4_language_id": langid.op4_language_id,
        "op5_mix_sources": mixing.op5_mix_sources,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_token_shards": sstable.op7_token_shards,
        "op8_license_scan": licenses.op8_license_scan,
        "op9_substring_dedup": substrings.op9_substring_dedup,
        "op10_pii": pii.op10_pii,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_mix_sources": mixing.OP5_SQL}
