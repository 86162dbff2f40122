"""Queries of this subpackage and the SQL that their results can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bm25, flac, near_dedup, ngram_join, packing, pieces, pii, resampling, suffix_dedup, token_counts, toxicity, warc, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op5_packing": packing.query,
        "op4_pii": pii.query,
        "op6_warc": warc.query,
        "op7_flac": flac.query,
        "op8_toxicity": toxicity.query,
        "op3_near_dedup": near_dedup.query,
        "op1_suffix_dedup": suffix_dedup.query,
        "op9_pieces": pieces.query,
        "op10_bm25": bm25.query,
        "op2_token_counts": token_counts.query,
        "op11_resampling": resampling.query,
        "op12_whitening": whitening.query,
        "op13_ngram_join": ngram_join.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": warc.ORACLE_SQL, "op11_resampling": resampling.ORACLE_SQL}
