"""Registered queries of the repeated lines and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.repeated_lines import LineStore, repeated_line_occurrences
from loam.sources.scratch import scratch_path, stored
from loam.sources.tables import read_table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_line_occurrences(read_table(spark, folder, "stored_doc"))


def p1_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Each document without the lines that its site repeats.

    Documents arrive in two deltas (by hash); after each, only the new ones and those with lines that crossed are built.
    Of differing rows of one stored_id the one with the greatest content holds.
    """
    docs = read_table(spark, folder, "stored_doc").select("stored_id", "site", "content")
    docs = stored(docs.where("stored_id is not null").groupBy("stored_id").agg(F.max(F.struct("content", "site")).alias("d")).select("stored_id", "d.site", "d.content"), "documents")
    store, late = LineStore(spark, scratch_path(spark, "line-store")), F.pmod(F.xxhash64("stored_id"), F.lit(2)) == 1
    first = stored(store.rebuilt(docs.where(~late), store.merge(docs.where(~late))), "cleaned")
    delta = store.merge(docs.where(late))
    again = store.rebuilt(docs, delta)
    return first.join(delta.touched, "stored_id", "left_anti").unionByName(again).select("stored_id", "content", "removed_lines")


def p1_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """The counts grown in two deltas (fetched before and from March): per site and kind of crossing, the lines that the
    second delta moves over the threshold and the documents in which they stand."""
    docs = read_table(spark, folder, "stored_doc").where("stored_id is not null")
    early = F.coalesce(F.col("fetched_at") < F.lit("2024-03-01").cast("timestamp_ntz"), F.lit(True))
    store = LineStore(spark, scratch_path(spark, "line-store"))
    store.merge(docs.where(early))
    delta = store.merge(docs.where(~early))
    sites = docs.select(F.coalesce("site", F.lit("")).alias("site")).distinct().withColumn("site_hash", F.xxhash64("site"))
    return (
        delta.crossed.join(store.counts().lines, ["site_hash", "line_hash"])
        .join(sites, "site_hash")
        .groupBy("site", "now_repeated")
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("docs").alias("docs"))
    )


_FORM = r"""
WITH doc AS (SELECT DISTINCT stored_id, coalesce(site, '') AS site, content FROM stored_doc WHERE stored_id IS NOT NULL),
line AS (
  SELECT stored_id, site, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM doc),
form AS (
  SELECT stored_id, site, line_no, regexp_replace(lower(upper(regexp_replace(line,
    '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', '', 'g'))), '[0-9]+', '0', 'g') AS form FROM line),
n AS (SELECT site, form, count(DISTINCT stored_id) AS docs FROM form WHERE regexp_matches(form, '\p{L}') GROUP BY ALL),
total AS (SELECT site, count(DISTINCT stored_id) AS of_site FROM doc GROUP BY ALL),
hit AS (SELECT site, form FROM n JOIN total USING (site) WHERE docs >= 5 AND 20 * docs >= of_site)
"""

#: Counts of a state: of the first delta, and of both. A document of both is counted with the first.
_STATES = r"""
WITH raw AS (SELECT DISTINCT stored_id, coalesce(site, '') AS site, content, coalesce(fetched_at < TIMESTAMP '2024-03-01', true) AS early FROM stored_doc WHERE stored_id IS NOT NULL),
old AS (SELECT DISTINCT stored_id FROM raw WHERE early),
doc AS (SELECT DISTINCT stored_id, site, content, early FROM raw WHERE early OR stored_id NOT IN (SELECT stored_id FROM old)),
line AS (SELECT stored_id, site, early, unnest(string_split(content, chr(10))) AS line FROM doc),
form AS (SELECT DISTINCT stored_id, site, early, regexp_replace(lower(upper(regexp_replace(line,
    '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', '', 'g'))), '[0-9]+', '0', 'g') AS form FROM line),
n AS (SELECT site, form, count(DISTINCT stored_id) FILTER (early) AS a, count(DISTINCT stored_id) AS b FROM form WHERE regexp_matches(form, '\p{L}') GROUP BY ALL),
total AS (SELECT site, count(DISTINCT stored_id) FILTER (early) AS ta, count(DISTINCT stored_id) AS tb FROM doc GROUP BY ALL),
state AS (SELECT site, b, a >= 5 AND 20 * a >= ta AS was, b >= 5 AND 20 * b >= tb AS now FROM n JOIN total USING (site))
SELECT site, now AS now_repeated, count(*) AS lines, CAST(sum(b) AS BIGINT) AS docs FROM state WHERE was <> now GROUP BY site, now
"""

QUERIES = {"p1_found": p1_found, "p1_cleaned": p1_cleaned, "p1_deltas": p1_deltas}

SQL = {
    "p1_deltas": _STATES,
    "p1_found": _FORM + "SELECT DISTINCT stored_id, CAST(line_no AS INTEGER) AS line_no FROM form JOIN hit USING (site, form)",
    "p1_cleaned": _FORM
    + r""", gone AS (SELECT DISTINCT stored_id, line_no FROM form JOIN hit USING (site, form)),
kept AS (
  SELECT stored_id, string_agg(line, chr(10) ORDER BY line_no) AS content FROM line WHERE NOT EXISTS (
    SELECT 1 FROM gone WHERE gone.stored_id = line.stored_id AND gone.line_no = line.line_no) GROUP BY stored_id)
SELECT doc.stored_id, CASE WHEN doc.content IS NOT NULL THEN coalesce(kept.content, '') END AS content,
       CAST((SELECT count(*) FROM gone WHERE gone.stored_id = doc.stored_id) AS INTEGER) AS removed_lines
FROM doc LEFT JOIN kept USING (stored_id)""",
}
