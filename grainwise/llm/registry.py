"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, lm_scoring, mixing, packing, pii, quality_classifier, quality_rules, resampling, sharding, simhash, spelling, substring_dedup, token_output


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        substring_dedup.op1_substring_dedup,
        lm_scoring.op2_lm_scoring,
        simhash.op3_simhash,
        token_output.op4_token_output,
        sharding.op5_shards,
        mixing.op6_mix_sources,
        quality_rules.op7_quality_rules,
        pii.op8_pii,
        quality_classifier.op9_quality_classifier,
        decontamination.op10_decontamination,
        packing.op11_pack,
        spelling.op12_spelling,
        resampling.op13_resample,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": substring_dedup.SQL, "op6_mix_sources": mixing.SQL, "op7_quality_rules": quality_rules.SQL, "op12_spelling": spelling.SQL, "op13_resample": resampling.SQL}
