"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, fingerprint, language_id, license_scan, line_dedup, near_dedup, packing, quality, sql, token_count

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_quality_classifier": quality.op2_quality_classifier,
        "op3_license_scans": license_scan.op3_license_scans,
        "op4_near_dedup": near_dedup.op4_near_dedup,
        "op5_packing": packing.op5_packing,
        "op6_decontamination": decontaminate.op6_decontamination,
        "op7_fingerprints": fingerprint.op7_fingerprints,
        "op8_chat_formatting": chat.op8_chat_formatting,
        "op9_token_counts": token_count.op9_token_counts,
        "op10_language_id": language_id.op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    """The fitted operators, the tokenizer's and the fingerprints have none: tests hold them against brute force."""
    return {
        "op1_line_dedup": sql.LINE_DEDUP,
        "op3_license_scans": sql.LICENSE_SCANS,
        "op4_near_dedup": sql.NEAR_DEDUP,
        "op6_decontamination": sql.DECONTAMINATION,
        "op8_chat_formatting": chat.SQL,
    }
