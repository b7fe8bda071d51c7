"""Registered queries of the main body extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loam.llm.main_body import furniture_lines, main_bodies
from loam.sources.tables import read_table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return furniture_lines(read_table(spark, folder, "page_text")).distinct()


def p4_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The main body of each page."""
    return main_bodies(read_table(spark, folder, "page_text"))


QUERIES = {"p4_found": p4_found, "p4_bodies": p4_bodies}
SQL: dict[str, str] = {}
