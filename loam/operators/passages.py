"""The densest passage of a text: windows over its lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import lines

#: Hit lines farther apart belong to different clusters; longer clusters are cut around their first peak.
MAX_STEP, MAX_LINES, BEFORE_PEAK, AFTER_PEAK = 5, 15, 5, 10


def dense_blocks(df: DataFrame, keys: list[str], content: str, tokens: str) -> DataFrame:
    """The stretch of lines with the most query tokens in it: the keys, start_line, end_line (from 1), matched_block.

    A line counts the different tokens that stand in it as substrings. Lines with enough of them, at most MAX_STEP apart,
    form clusters; the one with the largest sum is taken, the first of equals. No hit, null or empty content: 0, 0 and
    an empty block. The keys name one row.
    """
    split = df.select(*keys, lines(F.col(content)).alias("_lines"), F.array_distinct(tokens).alias("_t"))
    each = split.select(*keys, F.posexplode("_lines").alias("line", "text"), "_t")
    hits = each.select(*keys, "line", F.size(F.filter("_t", lambda t: F.contains(F.lower(F.col("text")), t))).alias("hits"))
    of_row = Window.partitionBy(*keys)
    most = F.max("hits").over(of_row)
    enough = F.when(most >= 6, F.greatest(F.lit(2), F.floor(most / 4))).otherwise(1)
    strong = hits.where("hits > 0").withColumn("enough", enough).where("hits >= enough")
    by_line = of_row.orderBy("line")
    step = F.col("line") - F.lag("line").over(by_line)
    clustered = strong.withColumn("new", F.when(step > MAX_STEP, 1).otherwise(0)).withColumn("cluster", F.sum("new").over(by_line))
    of_cluster = clustered.groupBy(*keys, "cluster").agg(
        F.sum("hits").alias("total"), F.min("line").alias("first"), F.max("line").alias("last"), F.min_by("line", F.struct(-F.col("hits"), F.col("line"))).alias("peak")
    )
    best = of_cluster.groupBy(*keys).agg(F.min_by(F.struct("first", "last", "peak"), F.struct(-F.col("total"), F.col("first"))).alias("b"))
    long = F.col("b.last") - F.col("b.first") + 1 > MAX_LINES
    start = F.when(long, F.greatest(F.col("b.peak") - BEFORE_PEAK, F.lit(0))).otherwise(F.col("b.first"))
    end = F.when(long, F.least(F.col("b.peak") + AFTER_PEAK, F.col("b.last"))).otherwise(F.col("b.last"))
    found = best.select(*keys, (start + 1).alias("start_line"), (end + 1).alias("end_line"))
    block = F.array_join(F.slice("_lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return split.join(found, keys, "left").select(
        *keys, F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line"), F.when(F.col("start_line").isNull(), "").otherwise(block).alias("matched_block")
    )
