"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bilinear_lm, chats, importance, license_scan, line_dedup, mixing, pieces, quality, simhash, suffix_dedup, url_filter,
    vector_dedup, word_runs)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.op1,
    "op2_source_mixing": mixing.op2,
    "op3_line_dedup": line_dedup.op3,
    "op4_url_filter": url_filter.op4,
    "op5_chat_snapshots": chats.op5,
    "op6_sentencepiece": pieces.op6,
    "op7_license_scan": license_scan.op7,
    "op8_vector_groups": vector_dedup.op8,
    "op9_simhash": simhash.op9,
    "op10_suffix_dedup": suffix_dedup.op10,
    "op11_word_runs": word_runs.op11,
    "op12_bilinear_lm": bilinear_lm.op12,
    "op13_importance_resampling": importance.op13,
}
SQL: dict[str, str] = {
    "op3_line_dedup": line_dedup.SQL, "op4_url_filter": url_filter.SQL, "op5_chat_snapshots": chats.SQL}
