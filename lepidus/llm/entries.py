"""Queries of this package, for the registry at the repository's top."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lepidus.llm import bpe, licenses, matroska, packing, pivots, quality, simhash, suffix, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.query,
        "op2_pivots": pivots.query,
        "op3_bpe": bpe.query,
        "op4_simhash": simhash.query,
        "op5_quality": quality.query,
        "op6_toxicity": toxicity.query,
        "op7_matroska": matroska.query,
        "op8_suffix_array": suffix.query,
        "op9_licenses": licenses.query,
        "op10_packing": packing.query,
    }


def oracle_sql() -> dict[str, str]:
    """Of the others, each result holds bytes, trained weights, fingerprints or plans that SQL can't make; tests compare them with brute force."""
    return {"op2_pivots": pivots.SQL, "op8_suffix_array": suffix.SQL}
