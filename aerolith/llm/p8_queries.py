"""Problem 8: posts that look the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aerolith.llm import lookalike
from aerolith.runtime import table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.pairs(*lookalike.lookalikes(table(spark, sf_dir, "documents"), "doc_id", "text"))


def p8_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every visible post with the canonical member of its class."""
    return lookalike.canonical(*lookalike.lookalikes(table(spark, sf_dir, "documents"), "doc_id", "text"))


QUERIES = {"p8_found": p8_found, "p8_canonical": p8_canonical}
SQL: dict[str, str] = {}
