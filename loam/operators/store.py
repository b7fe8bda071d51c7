"""The incremental document store: statuses of a batch, index upserts and unions, site overviews.

The index is a table (site, file_key, md5, fetched_at, ...) with one row a file. A batch never changes rows in place: an
upsert gives the next version of the table, which ``write_index`` puts beside the old one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.urls import PATH_PRIORITY

#: Files of a site in a version of the index, at most.
WRITERS = 8
#: How statuses are ordered in listings; others come last.
STATUS_ORDER = ("new", "updated", "unchanged", "error")


def content_hash(raw: Column, html: Column, content: Column) -> Column:
    """MD5 of the raw bytes, else of the page, else of the content."""
    return F.md5(F.coalesce(raw, F.encode(html, "UTF-8"), F.encode(content, "UTF-8")))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the last in ``order``. Nulls come first."""
    by_key = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
    return rows.withColumn("_n", F.row_number().over(by_key)).where("_n = 1").drop("_n")


def batch_status(batch: DataFrame, index: DataFrame, detect_deleted: bool = False) -> DataFrame:
    """Each file of a batch (site, file_key, md5) against the index: site, file_key, md5, status.

    A key that the index lacks is ``new``; another hash (or an unknown one on either side) makes ``updated``. With
    ``detect_deleted`` the batch is a full listing, and what it lacks is ``deleted``. One row a key on either side.
    """
    old = index.select("site", "file_key", F.col("md5").alias("old_md5"), F.lit(True).alias("known"))
    new = batch.select("site", "file_key", "md5", F.lit(True).alias("delivered"))
    joined = new.join(old, ["site", "file_key"], "full" if detect_deleted else "left")
    status = (
        F.when(F.col("delivered").isNull(), "deleted")
        .when(F.col("known").isNull(), "new")
        .when(F.col("md5") == F.col("old_md5"), "unchanged")
        .otherwise("updated")
    )
    return joined.select("site", "file_key", "md5", status.alias("status"))


def upsert(index: DataFrame, batch: DataFrame) -> DataFrame:
    """The index after a batch: the batch's row for a key it delivers, else the index's."""
    kept = index.join(batch.select("site", "file_key"), ["site", "file_key"], "left_anti")
    return kept.unionByName(batch.select(*index.columns))


def union_with_legacy(index: DataFrame, legacy: DataFrame) -> DataFrame:
    """All rows of the index, and those of an older layout whose key it lacks."""
    return index.unionByName(legacy.join(index.select("site", "file_key"), ["site", "file_key"], "left_anti").select(*index.columns))


def site_overview(index: DataFrame, documents: DataFrame) -> DataFrame:
    """Sites with their number of files (of the index, else of the stored documents) and last update, by name.

    Sites with neither are left out. ``documents`` has site and file_key.
    """
    counted = index.groupBy("site").agg(F.count(F.lit(1)).alias("indexed"), F.max("fetched_at").alias("last_updated"))
    stored = documents.groupBy("site").agg(F.count(F.lit(1)).alias("documents"))
    files = F.coalesce(F.nullif(F.col("indexed"), F.lit(0)), F.col("documents"), F.lit(0))
    return counted.join(stored, "site", "full").select("site", files.alias("file_count"), "last_updated").where("file_count > 0").orderBy("site")


def resolved_path(files: DataFrame) -> DataFrame:
    """Of several files of one name (site, base, extension) the processed one: site, base, extension."""
    rank = F.create_map(*[F.lit(x) for i, e in enumerate(PATH_PRIORITY) for x in (e, i)])
    ranked = files.withColumn("_r", F.try_element_at(rank, F.col("extension"))).where("_r is not null")
    return ranked.groupBy("site", "base").agg(F.min_by("extension", "_r").alias("extension"))


def labelled(index: DataFrame, reports: DataFrame) -> DataFrame:
    """Index rows with the status that the crawler's lists give them: ``index`` with status and status_rank.

    ``reports``: site, new_files, updated_files. A file in both lists is new; one in none is unchanged.
    """
    listed = lambda column, name: reports.select("site", F.explode(column).alias("file_key")).distinct().withColumn(name, F.lit(True))
    status = F.when(F.col("_new"), "new").when(F.col("_upd"), "updated").otherwise("unchanged")
    joined = index.join(listed("new_files", "_new"), ["site", "file_key"], "left").join(listed("updated_files", "_upd"), ["site", "file_key"], "left")
    return joined.withColumn("status", status).withColumn("status_rank", status_rank(F.col("status"))).drop("_new", "_upd")


def status_rank(status: Column) -> Column:
    out = F.lit(len(STATUS_ORDER))
    for i, name in reversed(list(enumerate(STATUS_ORDER))):
        out = F.when(status == name, i).otherwise(out)
    return out


def crawl_summary(reports: DataFrame) -> DataFrame:
    """Per site and snapshot what its runs report: runs, failed, new, updated, deleted. Null lists count nothing."""
    n = lambda c: F.sum(F.coalesce(F.size(F.col(c)), F.lit(0)))
    return reports.groupBy("site", "snapshot_no").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("success")).alias("failed"), n("new_files").alias("new"), n("updated_files").alias("updated"), n("deleted_files").alias("deleted")
    )


def write_index(index: DataFrame, folder: str, version: int) -> str:
    """Write a version of the index, partitioned by site, and give its path; readers of older versions are not disturbed."""
    path = f"{folder}/version={version:08d}"
    # a site of very many files is written by several tasks
    index.repartition("site", F.pmod(F.xxhash64("file_key"), F.lit(WRITERS))).write.mode("errorifexists").partitionBy("site").parquet(path)
    return path


def without_site(index: DataFrame, site: str) -> DataFrame:
    """The index after a site is cleared. Names with path separators are refused."""
    if not site or "/" in site or "\\" in site or site in (".", ".."):
        raise ValueError("not a site name")
    return index.where(F.col("site") != site)
