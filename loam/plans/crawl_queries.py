"""Registered queries of the link graph, the logs and the streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.urls import normalize_url
from loam.operators import crawl as C
from loam.operators import logs as L
from loam.operators import pipeline as P
from loam.operators.snapshots import hex_value, moment
from loam.plans.store_queries import _S as _ENTRIES
from loam.sources.scratch import scratch_path, stored
from loam.sources.tables import read_table
from loam.streaming import log_stream as S

MAX_DEPTH = 5


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between the pages by number, as the pages' own links mostly lead outside of the table: k to the pages that
    follow 2k and 3k among as many numbers as there are pages."""
    pages = read_table(spark, folder, "page_text").select(F.col("page_id").alias("k")).distinct()
    n = pages.agg(F.max("k").alias("n"))
    to = F.explode(F.array((F.col("k") * 2 + 1) % F.col("n") + 1, (F.col("k") * 3 + 2) % F.col("n") + 1))
    return pages.join(F.broadcast(n)).select(F.col("k").alias("src"), to.alias("dst"))  # n is one row


def _frontier(spark: SparkSession, folder: str) -> DataFrame:
    seeds = read_table(spark, folder, "page_text").agg(F.min("page_id").alias("url"))
    return C.breadth_first(_edges(spark, folder), seeds, MAX_DEPTH, cap=None)


def frontier_bfs(spark: SparkSession, folder: str) -> DataFrame:
    return _frontier(spark, folder).select(F.col("url").alias("page_id"), "depth")


def depth_stats(spark: SparkSession, folder: str) -> DataFrame:
    return C.depth_statistics(_frontier(spark, folder))


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    return C.markdown_links(read_table(spark, folder, "page_text").select("url", "content").distinct())


def _link_frontier(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "page_text").where("url is not null")
    edges = stored(page_links(spark, folder), "crawl-edges")  # read once a level
    return C.breadth_first(edges, pages.select(normalize_url(F.col("url")).alias("url")), None, cap=None)


def link_frontier(spark: SparkSession, folder: str) -> DataFrame:
    """All that the pages' own links reach from the pages of every site, until a level finds nothing new."""
    return _link_frontier(spark, folder).select("url", "depth")


def link_depth_stats(spark: SparkSession, folder: str) -> DataFrame:
    return C.depth_statistics(_link_frontier(spark, folder))


def crawl_store(spark: SparkSession, folder: str) -> DataFrame:
    """A crawl that starts from every stored page, follows their links and compares what it keeps with the first snapshot's
    index: per depth and kind, addresses asked and kept, and documents by status.

    The stored pages stand for the net: an address that is none of them gives an error.
    """
    table = read_table(spark, folder, "page_text").where("url is not null and content is not null")
    row = F.struct("page_id", "content")
    net = table.select(normalize_url(F.col("url")).alias("url"), "page_id", "content").groupBy("url").agg(F.min(row)["content"].alias("text"))
    net = stored(net, "crawl-net")

    def source(level: DataFrame) -> DataFrame:
        found = level.select("url").join(net, "url", "left")
        lost = F.col("text").isNull()
        return found.select(
            "url", F.when(lost, 404).otherwise(200).alias("status"), F.lit("text/plain").alias("content_type"), F.lit(None).cast("binary").alias("body"), "text", F.when(lost, "HTTP 404").alias("error")
        )

    index = spark.createDataFrame([], P.INDEX)
    done = P.crawl(source, table.select("url"), index, [".md", ".html"], max_depth=3, min_year=2020, cap=None)
    return done.pages.groupBy("depth", "kind").agg(F.count(F.lit(1)).alias("asked"), F.count_if("kept").alias("kept"))


def crawl_log_parse(spark: SparkSession, folder: str) -> DataFrame:
    lines = L.run_log(read_table(spark, folder, "crawl_result").dropDuplicates(["run_id"]))
    return L.parsed(lines).select("run_id", "line_no", "status", "file_name", "url")


def pre_crawl_log_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Discovery lines written for every fetched address, and read back."""
    pages = read_table(spark, folder, "page_text").where("url is not null").select("page_id", "url", "content_type").distinct()
    doc = F.when(F.col("content_type") == "text/html", "").otherwise("(doc) ")
    line = F.concat(F.lit("  [pre-crawl] depth="), (F.col("page_id") % 4).cast("string"), F.lit(" found="), F.col("page_id").cast("string"), F.lit(" "), F.coalesce(doc, F.lit("")), F.col("url"))
    return L.discovery(pages.select(F.lit(0).alias("run_id"), F.col("page_id").alias("line_no"), line.alias("line"))).drop("run_id")


def progress_eta(spark: SparkSession, folder: str) -> DataFrame:
    """The events of each user as the progress of a run."""
    events = read_table(spark, folder, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("item"), F.col("ts").alias("at"))
    totals = events.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return L.progress(events.join(totals, "run"), F.col("n"))


def stream_log_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The run logs read as a stream with state; lines by status, and how many of them have an address."""
    reports = S.file_stream(spark, folder, "crawl_result.parquet")
    lines = S.appended(S.parsed_stream(L.run_log(reports)), scratch_path(spark, "log-stream"), "lines").distinct()
    return lines.groupBy("status").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("url") != "").alias("with_url"))


def stream_store(spark: SparkSession, folder: str) -> DataFrame:
    """The first snapshot's rows merged into an empty store as a stream: files by status."""
    rows = S.file_stream(spark, folder, "index_entry.parquet").where("snapshot_no = 1 and file_key is not null").select("site", "file_key", "md5", "entry_id")
    statuses = S.incremental_store(spark, rows, scratch_path(spark, "store-stream"))
    return statuses.where("status = 'new'").groupBy("status").agg(F.sum("files").alias("files"))


def stream_store_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """All snapshots merged into one store as a stream, a micro-batch each, in their order: statuses that each batch met.

    The files of a snapshot are put into the stream's folder and worked off before the next ones come, so that a batch
    holds a whole snapshot in any number of files, and state goes on from the checkpoint.
    """
    root, source = scratch_path(spark, "store-stream"), scratch_path(spark, "store-stream-in")
    rows = read_table(spark, folder, "index_entry").where("snapshot_no is not null and site is not null and file_key is not null")
    numbers = [x[0] for x in rows.select("snapshot_no").distinct().orderBy("snapshot_no").collect()]  # one row a snapshot
    last = F.struct(moment(F.col("fetch_date")).alias("fetched_at"), "entry_id")  # as in the queries of the store
    entries = rows.select("site", "file_key", hex_value(F.col("md5")).alias("md5"), last.alias("entry_id"))
    if not numbers:
        return spark.createDataFrame([], "batch long, status string, files long")
    for number in numbers:
        entries.where(F.col("snapshot_no") == number).write.mode("append").parquet(source)
        statuses = S.incremental_store(spark, spark.readStream.schema(entries.schema).parquet(source), root)
    return statuses


_LOG = """
WITH r AS (SELECT DISTINCT ON (run_id) * FROM crawl_result ORDER BY run_id),
f AS (SELECT run_id, success, coalesce(len(new_files), 0) AS n, list_concat(coalesce(new_files, []), coalesce(updated_files, [])) AS fs FROM r),
l AS (SELECT run_id, unnest(list_concat(flatten(list_transform(fs, lambda f, i: [['info', '', 'https://' || f], [CASE WHEN i <= n THEN 'new' ELSE 'updated' END, trim(f), trim('https://' || f)]])),
  CASE WHEN success THEN [] ELSE [['error', '', ''], ['skip', '', 'https://old.example/2019']] END)) AS x FROM f)
"""
QUERIES = {
    f.__name__: f for f in (frontier_bfs, depth_stats, page_links, link_frontier, link_depth_stats, crawl_store, crawl_log_parse, pre_crawl_log_parse, progress_eta, stream_log_counts, stream_store, stream_store_snapshots)
}
_BFS = f"""
WITH RECURSIVE p AS (SELECT DISTINCT page_id AS k FROM page_text), n AS (SELECT max(k) AS n FROM p),
e AS (SELECT k AS src, (k * 2 + 1) % n + 1 AS dst FROM p, n UNION SELECT k, (k * 3 + 2) % n + 1 FROM p, n),
b AS (SELECT min(k) AS node, 0 AS depth FROM p UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < {MAX_DEPTH}),
r AS (SELECT node AS page_id, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY node)
"""
SQL = {
    "frontier_bfs": _BFS + "SELECT page_id, depth FROM r",
    "depth_stats": _BFS + "SELECT depth, urls, CAST(sum(urls) OVER (ORDER BY depth) AS BIGINT) AS cumulative FROM (SELECT depth, count(*) AS urls FROM r GROUP BY depth)",
    "page_links": r"""
WITH p AS (SELECT DISTINCT url, content FROM page_text WHERE url IS NOT NULL AND content IS NOT NULL),
h AS (SELECT url, unnest(regexp_extract_all(content, '\[[^\]]*\]\(([^)\s]+)\)', 1)) AS href FROM p),
a AS (SELECT url, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || regexp_extract(url, '://([^/?#]*)', 1) AS root, href FROM h WHERE NOT regexp_matches(href, '^(javascript:|mailto:|tel:|#)')),
d AS (SELECT url, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN starts_with(href, '/') THEN root || href ELSE root || regexp_extract(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '^(.*/)', 1) || href END AS dst FROM a),
n AS (SELECT url AS u, dst AS v FROM d),
m AS (SELECT lower(regexp_extract(u, '^([a-zA-Z]+)://', 1)) || '://' || regexp_extract(u, '://([^/?#]*)', 1) || coalesce(nullif(rtrim(regexp_replace(regexp_extract(u, '://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/'), ''), '/') || regexp_extract(u, '^[^?#]*(\?[^#]+)', 1) AS src,
             lower(regexp_extract(v, '^([a-zA-Z]+)://', 1)) || '://' || regexp_extract(v, '://([^/?#]*)', 1) || coalesce(nullif(rtrim(regexp_replace(regexp_extract(v, '://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/'), ''), '/') || regexp_extract(v, '^[^?#]*(\?[^#]+)', 1) AS dst FROM n)
SELECT DISTINCT src, dst FROM m WHERE regexp_extract(src, '://([^/?#]*)', 1) = regexp_extract(dst, '://([^/?#]*)', 1)""",
    "crawl_log_parse": _LOG + """, o AS (SELECT run_id, x, row_number() OVER () AS k FROM l)
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY k) - 1 AS INTEGER) AS line_no, x[1] AS status, x[2] AS file_name, trim(x[3]) AS url FROM o""",
    "pre_crawl_log_parse": """
SELECT DISTINCT page_id AS line_no, CAST(page_id % 4 AS INTEGER) AS depth, CAST(page_id AS INTEGER) AS found, coalesce(content_type, '') <> 'text/html' AS is_doc, url FROM page_text WHERE url IS NOT NULL""",
    "progress_eta": """
WITH e AS (SELECT user_id AS run, event_id AS item, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS s FROM events)
SELECT run, item, CAST(number AS INTEGER) AS number, CAST(least(99, floor(100 * number / total + 0.5)) AS INTEGER) AS percent, CASE WHEN s > 0 THEN round(number / s, 6) END AS rate,
  CASE WHEN s > 0 THEN CAST(floor((total - number) / (number / s) + 0.5) AS BIGINT) END AS seconds_left FROM e""",
    "stream_log_counts": _LOG + "SELECT x[1] AS status, count(*) AS lines, count(*) FILTER (x[3] <> '') AS with_url FROM l GROUP BY ALL",
    "stream_store": "SELECT 'new' AS status, CAST(count(DISTINCT (site, file_key)) AS BIGINT) AS files FROM index_entry WHERE snapshot_no = 1 AND file_key IS NOT NULL",
}
_NORMAL = r"""lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || regexp_extract(url, '://([^/?#]*)', 1) || coalesce(nullif(rtrim(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/'), ''), '/') || regexp_extract(url, '^[^?#]*(\?[^#]+)', 1)"""
_LINK_BFS = f"""
WITH RECURSIVE e AS ({SQL["page_links"]}),
b AS (SELECT DISTINCT {_NORMAL} AS url, 0 AS depth FROM page_text WHERE url IS NOT NULL UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.url WHERE b.depth <= (SELECT count(DISTINCT src) FROM e)),
r AS (SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY url)
"""
SQL["link_frontier"] = _LINK_BFS + "SELECT url, depth FROM r"
SQL["link_depth_stats"] = _LINK_BFS + "SELECT depth, urls, CAST(sum(urls) OVER (ORDER BY depth) AS BIGINT) AS cumulative FROM (SELECT depth, count(*) AS urls FROM r GROUP BY depth)"
_TEXT_YEAR = "list_max(flatten([" + ", ".join(f"list_transform(regexp_extract_all(text, '{p}', 1), lambda y: CAST(y AS INTEGER))" for p in (
    "((?:19|20)[0-9]{2})年", "((?:19|20)[0-9]{2})-(?:0[1-9]|1[0-2])(?:[^0-9]|$)", "((?:19|20)[0-9]{2})/(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])(?:[^0-9]|$)",
    "((?:19|20)[0-9]{2})/(?:0[1-9]|1[0-2])(?:[^0-9]|$)", "((?:19|20)[0-9]{2})_(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])(?:[^0-9]|$)", "((?:19|20)[0-9]{2})_(?:0[1-9]|1[0-2])(?:[^0-9]|$)")) + "]))"
SQL["crawl_store"] = f"""
WITH RECURSIVE net AS (SELECT {_NORMAL} AS url, arg_min(content, page_id) AS text FROM page_text WHERE url IS NOT NULL AND content IS NOT NULL GROUP BY 1),
l AS ({SQL["page_links"]}), e AS (SELECT DISTINCT src, dst FROM l),
b AS (SELECT url, 0 AS depth FROM net WHERE {_TEXT_YEAR.replace("(text,", "(url,")} IS NULL OR {_TEXT_YEAR.replace("(text,", "(url,")} >= 2020
  UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.url WHERE b.depth < 3 AND b.url IN (SELECT url FROM net) AND ({_TEXT_YEAR.replace("(text,", "(e.dst,")} IS NULL OR {_TEXT_YEAR.replace("(text,", "(e.dst,")} >= 2020)),
r AS (SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY url)
SELECT depth, CASE WHEN text IS NULL THEN 'error' ELSE kind END AS kind, count(*) AS asked, count(*) FILTER (text IS NOT NULL AND kind = 'text' AND coalesce({_TEXT_YEAR}, 2020) >= 2020) AS kept
FROM (SELECT depth, text, CASE WHEN regexp_matches(lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)), '[.](pdf|doc|docx|xls|xlsx|ppt|pptx)$') THEN 'binary' ELSE 'text' END AS kind FROM r LEFT JOIN net USING (url)) GROUP BY 1, 2
"""
SQL["stream_store_snapshots"] = _ENTRIES + """,
k AS (SELECT * FROM s WHERE snapshot_no IS NOT NULL AND site IS NOT NULL AND file_key IS NOT NULL),
n AS (SELECT snapshot_no, dense_rank() OVER (ORDER BY snapshot_no) - 1 AS batch FROM (SELECT DISTINCT snapshot_no FROM k)),
p AS (SELECT snapshot_no, md5, row_number() OVER w AS seen, lag(md5) OVER w AS old FROM k WINDOW w AS (PARTITION BY site, file_key ORDER BY snapshot_no))
SELECT CAST(batch AS BIGINT) AS batch, CASE WHEN seen = 1 THEN 'new' WHEN md5 = old THEN 'unchanged' ELSE 'updated' END AS status, count(*) AS files FROM p JOIN n USING (snapshot_no) GROUP BY ALL"""
