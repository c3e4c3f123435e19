"""The queries of the text operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sagitta.llm import bpe, fingerprint, langid, lm, mixing, neardup, ogg, pii, quality, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": fingerprint.query,
        "op2_toxicity": toxicity.query,
        "op3_source_mixing": mixing.query,
        "op4_language_id": langid.query,
        "op5_pii_pseudonyms": pii.query,
        "op6_language_model": lm.query,
        "op7_ogg_media": ogg.query,
        "op8_near_dedup": neardup.query,
        "op9_quality": quality.query,
        "op10_byte_bpe": bpe.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mixing": mixing.sql(), "op8_near_dedup": neardup.SQL}
