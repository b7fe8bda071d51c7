"""Registered queries of the personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loam.llm.pii import personal_data, redacted
from loam.sources.tables import read_table


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(read_table(spark, folder, "documents")).select("doc_id", "pii_type", "pii_text").distinct()


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with typed placeholders for its personal data."""
    return redacted(read_table(spark, folder, "documents"))


QUERIES = {"p8_found": p8_found, "p8_redacted": p8_redacted}
SQL: dict[str, str] = {}
