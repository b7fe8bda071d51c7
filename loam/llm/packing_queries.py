"""Registered queries of the packing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.packing import pack, token_counts
from loam.sources.scratch import stored
from loam.sources.tables import read_table


def token_limits(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(limit_name, max_size) of the limits in tokens; the table has a few rows at every scale."""
    rows = read_table(spark, folder, "size_limit").where("unit = 'token'").orderBy("limit_name").collect()
    return [(r.limit_name, r.max_size) for r in rows]


def p6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's container for each limit."""
    counts = stored(token_counts(read_table(spark, folder, "documents")), "token-counts")
    parts = [pack(counts, size).select(F.lit(name).alias("limit_name"), "*") for name, size in token_limits(spark, folder)]
    return reduce(DataFrame.unionByName, parts)


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Per limit: containers, tokens in them, and the part of their room that is filled."""
    sizes = dict(token_limits(spark, folder))
    per = p6_packing(spark, folder).where("length > 0").groupBy("limit_name", "container_id").agg(F.sum("length").alias("tokens"))
    room = F.create_map(*[x for name, size in sizes.items() for x in (F.lit(name), F.lit(size))])
    return per.groupBy("limit_name").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"),
        (F.sum("tokens") / (F.count(F.lit(1)) * F.max(room[F.col("limit_name")]))).alias("filled"),
    )


QUERIES = {"p6_packing": p6_packing, "p6_fill": p6_fill}
SQL: dict[str, str] = {}
