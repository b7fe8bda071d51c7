"""Registered queries of the repair of wrongly decoded text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.encoding_repair import repair_values
from loam.sources.tables import read_table

#: Where wrongly decoded values are looked for: table, id, column.
FIELDS = (("stored_doc", "stored_id", "content"), ("stored_doc", "stored_id", "title"), ("index_entry", "entry_id", "title"))


def _all_fields(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        repair_values(read_table(spark, folder, table), id_column, text).select(F.lit(f"{table}.{text}").alias("record_field"), "*")
        for table, id_column, text in FIELDS
    ]
    return reduce(DataFrame.unionByName, parts)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _all_fields(spark, folder).select("record_field", "record_id").distinct()


def p3_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Every affected value with its restored text."""
    return _all_fields(spark, folder).dropDuplicates(["record_field", "record_id"])


QUERIES = {"p3_found": p3_found, "p3_restored": p3_restored}
SQL: dict[str, str] = {}
