"""Registered queries of what a reader is shown, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import show as W
from loam.sources.tables import read_table


def located_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Where the passage of every answer stands in its document."""
    answers = read_table(spark, folder, "search_result").where("matched_block is not null").select("result_id", F.col("filename").alias("file_key"), "matched_block").distinct()
    docs = read_table(spark, folder, "stored_doc").where("content is not null").dropDuplicates(["stored_id"]).select("file_key", "content")
    return answers.join(docs, "file_key").withColumn("at", W.located(F.col("content"), F.col("matched_block"))).select("result_id", "at.start", "at.end")


def query_keywords(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "search_request").select("request_id", "query").distinct()
    return rows.select("request_id", F.array_join(W.keywords(F.col("query")), "/").alias("words"))


def marked_snippets(spark: SparkSession, folder: str) -> DataFrame:
    answers = read_table(spark, folder, "search_result").select("result_id", "request_id", "snippet", "score").distinct()
    asked = read_table(spark, folder, "search_request").select("request_id", "query").distinct()
    return answers.join(asked, "request_id").select("result_id", W.marked(F.col("snippet"), F.col("query")).alias("marked"), W.percent(F.col("score")).alias("percent"))


def markdown_preview(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "stored_doc").where("content is not null").dropDuplicates(["stored_id"])
    return docs.select("stored_id", W.preview(F.col("content"), F.lit(".md")).alias("html"))


QUERIES = {f.__name__: f for f in (located_blocks, query_keywords, marked_snippets, markdown_preview)}
_CLEAN = r"'[^\x{4e00}-\x{9fa5}a-zA-Z0-9]', '', 'g'"
SQL = {
    "located_blocks": f"""
WITH r AS (SELECT DISTINCT result_id, filename, matched_block FROM search_result WHERE matched_block IS NOT NULL),
d AS (SELECT DISTINCT ON (stored_id) file_key, content FROM stored_doc WHERE content IS NOT NULL ORDER BY stored_id),
c AS (SELECT result_id, regexp_replace(content, {_CLEAN}) AS w, regexp_replace(matched_block, {_CLEAN}) AS p FROM r JOIN d ON file_key = filename),
s AS (SELECT *, left(p, 20) AS a, right(p, 20) AS z, strpos(w, left(p, 20)) AS i FROM c),
e AS (SELECT *, CASE WHEN i > 0 THEN strpos(substr(w, i), z) END AS j FROM s)
SELECT result_id, CAST(CASE WHEN length(p) >= 5 AND i > 0 AND j > 0 THEN i - 1 ELSE -1 END AS INTEGER) AS start,
       CAST(CASE WHEN length(p) >= 5 AND i > 0 AND j > 0 THEN i - 1 + j - 1 + length(z) ELSE -1 END AS INTEGER) AS "end" FROM e""",
    "query_keywords": r"""
WITH q AS (SELECT DISTINCT request_id, query FROM search_request),
p AS (SELECT request_id, query, list_filter(string_split_regex(query, '[\s,，.。;；!！?？、()（）\[\]【】《》<>"''’‘“”:]+'), lambda w: trim(w) <> '') AS parts,
  list_filter(flatten(list_transform(regexp_extract_all(query, '[\x{4e00}-\x{9fa5}]+|[a-zA-Z0-9]+'), lambda r: CASE WHEN regexp_matches(r, '[a-zA-Z0-9]') THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)), lambda w: length(w) > 1) AS pieces FROM q),
u AS (SELECT request_id, query, unnest(list_concat(parts, pieces)) AS w, generate_subscripts(list_concat(parts, pieces), 1) AS i FROM p),
f AS (SELECT request_id, query, w, min(i) AS i FROM u GROUP BY ALL)
SELECT q.request_id, coalesce(string_agg(w, '/' ORDER BY length(w) DESC, i), '') AS words FROM q LEFT JOIN f USING (request_id, query) GROUP BY q.request_id, q.query""",
}
