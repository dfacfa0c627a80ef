"""The operators' queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geotiles.llm import license_scan, lm, mixing, ngram_join, packing, pii, quality_rules, secret_scan, vptree


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_token_output": packing.op2_token_output,
        "op3_pii": pii.op3_pii,
        "op4_secret_scan": secret_scan.op4_secret_scan,
        "op5_ngram_join": ngram_join.op5_ngram_join,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_vptree": vptree.op7_vptree,
        "op8_lm_scoring": lm.op8_lm_scoring,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.OP1_SQL,
        "op5_ngram_join": ngram_join.OP5_SQL,
        "op6_quality_rules": quality_rules.OP6_SQL,
        "op7_vptree": vptree.OP7_SQL,
    }
