"""The queries opN_<name> of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scanframe.llm import decontam, langid, line_dedup, lm_score, mixing, ngram_join, quality, secrets, token_counts, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_score": lm_score.op1,
        "op2_token_counts": token_counts.op2,
        "op3_warc_index": warc.op3,
        "op4_ngram_join": ngram_join.op4,
        "op5_secret_scan": secrets.op5,
        "op6_language_id": langid.op6,
        "op7_quality_rules": quality.op7,
        "op8_decontaminate": decontam.op8,
        "op9_mix_sources": mixing.op9,
        "op10_line_dedup": line_dedup.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc_index": warc.OP3_SQL,
        "op4_ngram_join": ngram_join.OP4_SQL,
        "op7_quality_rules": quality.sql(),
        "op8_decontaminate": decontam.OP8_SQL,
        "op10_line_dedup": line_dedup.OP10_SQL,
    }
