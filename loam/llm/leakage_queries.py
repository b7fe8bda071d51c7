"""Registered queries of the leakage search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.leakage import leaked_items
from loam.sources.tables import read_table


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_item")).select("doc_id", "item_id")


def p7_by_suite(spark: SparkSession, folder: str) -> DataFrame:
    """Per suite: its items, those that leaked, and the documents that leak them."""
    items = read_table(spark, folder, "eval_item")
    found = leaked_items(read_table(spark, folder, "documents"), items)
    return (
        items.select("suite", "item_id")
        .join(found, "item_id", "left")
        .groupBy("suite")
        .agg(F.countDistinct("item_id").alias("items"), F.countDistinct(F.when(F.col("doc_id").isNotNull(), F.col("item_id"))).alias("leaked_items"), F.countDistinct("doc_id").alias("documents"))
    )


QUERIES = {"p7_found": p7_found, "p7_by_suite": p7_by_suite}
SQL: dict[str, str] = {}
