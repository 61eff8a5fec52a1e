"""The operators' queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tributary.llm import align, bpe, chat, decontaminate, fingerprint, html, line_dedup, lm_scoring, mixing, near_dedup, quality, sharding, time_layout


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": lm_scoring.op1_lm_scoring,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_chat_formatting": chat.op3_chat_formatting,
        "op4_mixing": mixing.op4_mixing,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_sharding": sharding.op6_sharding,
        "op7_html_extraction": html.op7_html_extraction,
        "op8_near_dedup": near_dedup.op8_near_dedup,
        "op9_fingerprints": fingerprint.op9_fingerprints,
        "op10_byte_bpe": bpe.op10_byte_bpe,
        "op11_tokenizer_alignment": align.op11_tokenizer_alignment,
        "op12_decontamination": decontaminate.op12_decontamination,
        "op13_time_partitions": time_layout.op13_time_partitions,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_lm_scoring": lm_scoring.ORACLE, "op3_chat_formatting": chat.ORACLE, "op12_decontamination": decontaminate.ORACLE}
