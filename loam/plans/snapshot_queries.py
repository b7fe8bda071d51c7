"""Registered queries of the snapshot comparison and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loam.operators.snapshots import reported_against_derived, snapshot_changes
from loam.sources.tables import read_table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes(read_table(spark, folder, "index_entry")).select("snapshot_no", "file_key", "change_kind").distinct()


def p2_reported(spark: SparkSession, folder: str) -> DataFrame:
    changes = snapshot_changes(read_table(spark, folder, "index_entry"))
    return reported_against_derived(changes, read_table(spark, folder, "crawl_result"))


CHANGES_SQL = r"""
WITH r AS (
  SELECT site, snapshot_no, file_key, entry_id, TRY_CAST(replace(trim(fetch_date), 'T', ' ') AS TIMESTAMP) AS moment,
         regexp_replace(nullif(regexp_replace(regexp_replace(lower(md5), '[\s\x{a0}\x{3000}]+', '', 'g'), '^0x', ''), ''), '^0+(.)', '\1') AS h
  FROM index_entry WHERE site IS NOT NULL AND snapshot_no IS NOT NULL AND file_key IS NOT NULL),
s AS (
  SELECT site, snapshot_no, file_key, h FROM r
  QUALIFY row_number() OVER (PARTITION BY site, snapshot_no, file_key ORDER BY moment DESC NULLS LAST, entry_id DESC) = 1),
p AS (
  SELECT site, snapshot_no, lag(snapshot_no) OVER (PARTITION BY site ORDER BY snapshot_no) AS prev_no
  FROM (SELECT DISTINCT site, snapshot_no FROM s)),
n AS (SELECT s.*, p.prev_no FROM s JOIN p USING (site, snapshot_no) WHERE p.prev_no IS NOT NULL),
o AS (SELECT s.site, p.snapshot_no, s.file_key, s.h FROM s JOIN p ON s.site = p.site AND s.snapshot_no = p.prev_no),
d AS (
  SELECT coalesce(n.site, o.site) AS site, coalesce(n.snapshot_no, o.snapshot_no) AS snapshot_no, coalesce(n.file_key, o.file_key) AS file_key,
         CASE WHEN o.site IS NULL THEN 'added' WHEN n.site IS NULL THEN 'removed' WHEN n.h <> o.h THEN 'changed' END AS change_kind
  FROM n FULL JOIN o ON n.site = o.site AND n.snapshot_no = o.snapshot_no AND n.file_key = o.file_key)
"""

QUERIES = {"p2_found": p2_found, "p2_reported": p2_reported}

SQL = {
    "p2_found": CHANGES_SQL + "SELECT DISTINCT snapshot_no, file_key, change_kind FROM d WHERE change_kind IS NOT NULL",
    "p2_reported": CHANGES_SQL
    + r""", said AS (
  SELECT DISTINCT site, snapshot_no, kind AS change_kind,
         site || '/' || left(regexp_replace(regexp_replace(name, '^[^/]*/', ''), '[<>:"/\\|?*]', '_', 'g'), 200) AS file_key
  FROM (SELECT site, snapshot_no, 'changed' AS kind, unnest(updated_files) AS name FROM crawl_result
        UNION ALL SELECT site, snapshot_no, 'removed', unnest(deleted_files) FROM crawl_result))
SELECT coalesce(t.site, s.site) AS site, coalesce(t.snapshot_no, s.snapshot_no) AS snapshot_no, coalesce(t.change_kind, s.change_kind) AS change_kind,
       count(t.site) AS derived, count(s.site) AS reported, count(CASE WHEN t.site = s.site THEN 1 END) AS both
FROM (SELECT * FROM d WHERE change_kind IN ('changed', 'removed')) t
FULL JOIN said s ON t.site = s.site AND t.snapshot_no = s.snapshot_no AND t.change_kind = s.change_kind AND t.file_key = s.file_key
GROUP BY ALL""",
}
