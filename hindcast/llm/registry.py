"""Queries of this subpackage for __spark_entry__.py, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, licenses, lines, media, neardup, pii, repeats, sharding, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.query,
    "op2_bpe": bpe.query,
    "op3_lines": lines.query,
    "op4_licenses": licenses.query,
    "op5_neardup": neardup.query,
    "op6_sharding": sharding.query,
    "op7_decontaminate": decontaminate.query,
    "op8_media": media.query,
    "op9_repeats": repeats.query,
    "op10_toxicity": toxicity.query,
}

SQL: dict[str, str] = {
    "op3_lines": lines.SQL,
    "op6_sharding": sharding.SQL,
}
