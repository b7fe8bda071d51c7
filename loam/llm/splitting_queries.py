"""Registered queries of the splitting of oversized texts and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.splitting import oversized, piece_bounds, split_oversized
from loam.sources.scratch import stored
from loam.sources.tables import read_table

#: The column that names a record, by table.
ID_OF = {"stored_doc": "stored_id", "search_result": "result_id"}


def char_limits(spark: SparkSession, folder: str) -> list[tuple[str, str, int, int]]:
    """(table, column, max_size, overlap_size) of the limits in characters; the table has a few rows at every scale."""
    rows = read_table(spark, folder, "size_limit").where("unit = 'char'").orderBy("limit_name").collect()
    return [(*r.applies_to.split("."), r.max_size, r.overlap_size) for r in rows]


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The records that come out of the operator in pieces."""
    parts = []
    for table, column, most, overlap in char_limits(spark, folder):
        records = stored(oversized(read_table(spark, folder, table), ID_OF[table], column, most), "split-records")
        cut = piece_bounds(records, most, overlap).where("piece_no = 1")
        parts.append(cut.select(F.lit(f"{table}.{column}").alias("record_field"), F.col("rec").alias("record_id")))
    return reduce(DataFrame.unionByName, parts)


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every oversized record."""
    parts = [
        split_oversized(read_table(spark, folder, table), ID_OF[table], column, most, overlap).select(
            F.lit(f"{table}.{column}").alias("record_field"), F.col("rec").alias("record_id"), "piece_no", "piece_start", "piece_end", "piece"
        )
        for table, column, most, overlap in char_limits(spark, folder)
    ]
    return reduce(DataFrame.unionByName, parts)


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}

SQL = {
    "p5_found": """
SELECT DISTINCT 'stored_doc.content' AS record_field, stored_id AS record_id FROM stored_doc
WHERE length(content) > (SELECT max_size FROM size_limit WHERE applies_to = 'stored_doc.content')
UNION ALL
SELECT DISTINCT 'search_result.matched_block', result_id FROM search_result
WHERE length(matched_block) > (SELECT max_size FROM size_limit WHERE applies_to = 'search_result.matched_block')""",
}
