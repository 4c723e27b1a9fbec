"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickweave.llm import embedding_dedup, line_dedup, mixing, ngram_join, packing, private_data, quality_model, quality_rules, sharding, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.query,
        "op2_embedding_dedup": embedding_dedup.query,
        "op3_private_data": private_data.query,
        "op4_quality_rules": quality_rules.query,
        "op5_toxicity": toxicity.query,
        "op6_ngram_join": ngram_join.query,
        "op7_mixing": mixing.query,
        "op8_packing": packing.query,
        "op9_quality_model": quality_model.query,
        "op10_sharding": sharding.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.sql(),
        "op7_mixing": mixing.sql(),
        "op10_sharding": sharding.sql(),
    }
