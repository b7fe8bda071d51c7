"""Registered queries of the store and the address functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions import urls as U
from loam.operators import store as S
from loam.operators.snapshots import hex_value, moment
from loam.sources.tables import read_table

BASES = ("https://www.zhikao-hub.example/docs", "https://docs.gekebumo.test")
EXTENSIONS = (".pdf", ".docx")


def _urls(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "index_entry").where("source_url is not null").select(F.col("source_url").alias("url")).distinct()


def _snapshot(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """The index as one snapshot delivers it: site, file_key, md5, fetched_at, content_type."""
    rows = read_table(spark, folder, "index_entry").where(F.col("snapshot_no") == number)
    rows = rows.select("site", "file_key", hex_value(F.col("md5")).alias("md5"), moment(F.col("fetch_date")).alias("fetched_at"), "content_type", "entry_id")
    return S.latest(rows, ["site", "file_key"], [F.col("fetched_at"), F.col("entry_id")]).drop("entry_id")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "stored_doc").dropDuplicates(["stored_id"])


def normalize_urls(spark: SparkSession, folder: str) -> DataFrame:
    return _urls(spark, folder).select("url", U.normalize_url(F.col("url")).alias("normal"))


def url_site_filename(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("url")
    return _urls(spark, folder).select("url", U.site_of(u).alias("site"), U.filename_of(u).alias("file"), U.extension_of(u).alias("extension"), U.without_highlight(u).alias("bare"))


def url_scope_filter(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("url")
    return _urls(spark, folder).select("url", U.in_scope(u, BASES).alias("in_scope"), U.should_process(u, BASES, EXTENSIONS).alias("taken"))


def safe_name(spark: SparkSession, folder: str) -> DataFrame:
    return _urls(spark, folder).select("url", U.safe_name(F.col("url")).alias("name"))


def doc_kind_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "index_entry").where("source_url is not null").select("source_url", "content_type", "file_key").distinct()
    kind = U.kind_of(F.col("source_url"), F.col("content_type"))
    return rows.groupBy(kind.alias("kind"), U.stored_extension(F.col("content_type"), F.col("file_key")).alias("extension")).agg(F.count(F.lit(1)).alias("n"))


def max_year(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("stored_id", T.max_year(F.col("content")).alias("year"))


def min_year_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that a minimum year of 2024 keeps: those of no year or of that one or a later one."""
    year = T.max_year(F.col("content"))
    return _documents(spark, folder).where((year == 0) | (year >= 2024)).select("stored_id")


def content_md5(spark: SparkSession, folder: str) -> DataFrame:
    none = F.lit(None)
    return _documents(spark, folder).select("stored_id", S.content_hash(none.cast("binary"), none.cast("string"), F.col("content")).alias("md5"))


def incremental_status(spark: SparkSession, folder: str) -> DataFrame:
    out = S.batch_status(_snapshot(spark, folder, 4), _snapshot(spark, folder, 3), detect_deleted=True)
    return out.select("site", "file_key", "status")


def index_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return S.upsert(_snapshot(spark, folder, 3), _snapshot(spark, folder, 4)).select("site", "file_key", "md5")


def index_union(spark: SparkSession, folder: str) -> DataFrame:
    return S.union_with_legacy(_snapshot(spark, folder, 4), _snapshot(spark, folder, 1)).select("site", "file_key", "md5")


def site_list(spark: SparkSession, folder: str) -> DataFrame:
    return S.site_overview(_snapshot(spark, folder, 4), _documents(spark, folder).select("site", "file_key"))


def crawl_summary(spark: SparkSession, folder: str) -> DataFrame:
    return S.crawl_summary(read_table(spark, folder, "crawl_result").dropDuplicates(["run_id"]))


def resolve_path_priority(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "index_entry").where("file_key is not null")
    files = rows.select("site", F.regexp_replace("file_key", "^[^/]*/", "").alias("base"), U.stored_extension(F.col("content_type"), F.col("file_key")).alias("extension"))
    return S.resolved_path(files.distinct())


def status_order(spark: SparkSession, folder: str) -> DataFrame:
    reports = read_table(spark, folder, "crawl_result").where("snapshot_no = 4")
    return S.labelled(_snapshot(spark, folder, 4), reports).select("site", "file_key", "status", "status_rank")


def plain_preview(spark: SparkSession, folder: str) -> DataFrame:
    """Contents wrapped as the data file that each address names, and as a literal preview."""
    docs = _documents(spark, folder).where("content is not null")
    ext = F.ltrim(U.extension_of(F.coalesce("url", F.lit(""))), F.lit("."))
    return docs.select("stored_id", F.md5(T.plain_wrapped(F.col("content"), ext)).alias("wrapped"), F.md5(T.escaped_preview(F.col("content"))).alias("preview"))


_U = "WITH u AS (SELECT DISTINCT source_url AS url FROM index_entry WHERE source_url IS NOT NULL)"
_RE = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
_P = _U + rf""",
p AS (SELECT url, lower(regexp_extract(url, '{_RE}', 1)) AS scheme, regexp_extract(url, '{_RE}', 2) AS host, regexp_replace(regexp_extract(url, '{_RE}', 3), ';[^/]*$', '') AS path,
      regexp_extract(url, '{_RE}', 4) AS query FROM u)"""
_S = r"""
WITH r AS (SELECT site, file_key, snapshot_no, entry_id, content_type, TRY_CAST(replace(trim(fetch_date), 'T', ' ') AS TIMESTAMP) AS fetched_at,
  regexp_replace(nullif(regexp_replace(regexp_replace(lower(md5), '[\s\x{a0}\x{3000}]+', '', 'g'), '^0x', ''), ''), '^0+(.)', '\1') AS md5 FROM index_entry),
s AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY snapshot_no, site, file_key ORDER BY fetched_at DESC NULLS LAST, entry_id DESC) = 1)
"""
_YEARS = r"""
list_max(list_transform(list_concat(regexp_extract_all(content, '((?:19|20)\d{2})年', 1),
  regexp_extract_all(content, '((?:19|20)\d{2})-(?:0[1-9]|1[0-2])(?:[^0-9]|$)', 1),
  regexp_extract_all(content, '((?:19|20)\d{2})/(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:[^0-9]|$)', 1), regexp_extract_all(content, '((?:19|20)\d{2})/(?:0[1-9]|1[0-2])(?:[^0-9]|$)', 1),
  regexp_extract_all(content, '((?:19|20)\d{2})_(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:[^0-9]|$)', 1), regexp_extract_all(content, '((?:19|20)\d{2})_(?:0[1-9]|1[0-2])(?:[^0-9]|$)', 1)),
  lambda y: CAST(y AS INTEGER)))"""
_D = "WITH d AS (SELECT DISTINCT ON (stored_id) * FROM stored_doc ORDER BY stored_id)"
_TYPES = "CASE content_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in U.STORED_TYPES.items()) + " END"
_OWN = "CASE WHEN lower(regexp_extract(file_key, '(\\.[^.]*)$', 1)) IN (" + ", ".join(f"'{e}'" for e in U.STORED_EXTENSIONS) + ") THEN lower(regexp_extract(file_key, '(\\.[^.]*)$', 1)) END"
_STORED = f"coalesce({_TYPES}, {_OWN}, '.html')"
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"

QUERIES = {
    f.__name__: f
    for f in (normalize_urls, url_site_filename, url_scope_filter, safe_name, doc_kind_dispatch, max_year, min_year_filter, content_md5, incremental_status, index_upsert, index_union, site_list, crawl_summary, resolve_path_priority, status_order, plain_preview)
}

SQL = {
    "normalize_urls": _P + " SELECT url, scheme || '://' || host || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS normal FROM p",
    "url_site_filename": _P + r""" SELECT url, CASE WHEN host = '' THEN 'default' ELSE host END AS site, coalesce(nullif(left(regexp_replace(coalesce(nullif(trim(path, '/'), ''), 'index'), '[^\p{L}\p{N}\p{M}_-]', '_', 'g'), 200), ''), 'untitled') AS file,
        lower(regexp_extract(path, '(\.[^./]*)$', 1)) AS extension, regexp_replace(regexp_replace(url, '([?&])highlight=[^&#]*&?', '\1', 'g'), '[?&]($|#)', '\1') AS bare FROM p""",
    "url_scope_filter": _P + f""",
c AS (SELECT url, host, lower(path) AS lp, (host = 'www.zhikao-hub.example' AND (path = '/docs' OR starts_with(path, '/docs/'))) OR host = 'docs.gekebumo.test' AS in_scope, host IN ('www.zhikao-hub.example', 'docs.gekebumo.test') AS same FROM p)
SELECT url, in_scope, CASE WHEN regexp_matches(lp, '(\\.pdf|\\.docx|/pdf|/docx)$') OR contains(lp, '/pdf/') OR contains(lp, '/docx/') THEN same WHEN NOT in_scope THEN false WHEN regexp_matches(lp, '\\.html?$') THEN true
  WHEN contains(regexp_extract(lp, '([^/]*)$', 1), '.') THEN regexp_extract(lp, '(\\.[^./]*)$', 1) NOT IN {_LIST(U.KNOWN)} ELSE true END AS taken FROM c""",
    "safe_name": _U + r" SELECT url, regexp_replace(url, '[^\p{L}\p{N}_-]', '_', 'g') AS name FROM u",
    "doc_kind_dispatch": f"""
WITH r AS (SELECT DISTINCT source_url, content_type, file_key FROM index_entry WHERE source_url IS NOT NULL),
p AS (SELECT *, lower(regexp_extract(regexp_replace(regexp_extract(source_url, '{_RE}', 3), ';[^/]*$', ''), '(\\.[^./]*)$', 1)) AS ext, lower(trim(regexp_extract(coalesce(content_type, 'text/html'), '^([^;]*)', 1))) AS mime FROM r)
SELECT CASE WHEN contains(mime, 'text/html') AND ext NOT IN {_LIST(U.BINARY)} THEN 'html' WHEN mime IN {_LIST(U.BINARY_TYPES)} OR ext IN {_LIST(U.BINARY)} THEN 'binary'
  WHEN mime IN {_LIST(U.PLAIN_TYPES)} OR ext IN {_LIST(U.PLAIN)} THEN 'text' ELSE 'skip' END AS kind, {_STORED} AS extension, count(*) AS n FROM p GROUP BY ALL""",
    "max_year": _D + f" SELECT stored_id, CASE WHEN content IS NOT NULL THEN CAST(coalesce({_YEARS}, 0) AS INTEGER) END AS year FROM d",
    "min_year_filter": _D + f" SELECT stored_id FROM d WHERE content IS NOT NULL AND coalesce({_YEARS}, 2024) >= 2024",
    "content_md5": _D + " SELECT stored_id, md5(content) AS md5 FROM d",
    "incremental_status": _S + """, b AS (SELECT * FROM s WHERE snapshot_no = 4), i AS (SELECT * FROM s WHERE snapshot_no = 3)
SELECT coalesce(b.site, i.site) AS site, coalesce(b.file_key, i.file_key) AS file_key, CASE WHEN b.entry_id IS NULL THEN 'deleted' WHEN i.entry_id IS NULL THEN 'new' WHEN b.md5 = i.md5 THEN 'unchanged' ELSE 'updated' END AS status
FROM b FULL JOIN i ON b.site = i.site AND b.file_key = i.file_key""",
    "index_upsert": _S + "SELECT site, file_key, md5 FROM s WHERE snapshot_no IN (3, 4) QUALIFY row_number() OVER (PARTITION BY site, file_key ORDER BY snapshot_no DESC) = 1",
    "index_union": _S + "SELECT site, file_key, md5 FROM s WHERE snapshot_no IN (1, 4) QUALIFY row_number() OVER (PARTITION BY site, file_key ORDER BY snapshot_no DESC) = 1",
    "site_list": _S + """, i AS (SELECT site, count(*) AS n, max(fetched_at) AS last_updated FROM s WHERE snapshot_no = 4 GROUP BY site), d AS (SELECT site, count(DISTINCT stored_id) AS n FROM stored_doc GROUP BY site)
SELECT coalesce(i.site, d.site) AS site, coalesce(i.n, d.n) AS file_count, last_updated FROM i FULL JOIN d ON i.site = d.site""",
    "crawl_summary": """
WITH r AS (SELECT DISTINCT ON (run_id) * FROM crawl_result ORDER BY run_id)
SELECT site, snapshot_no, count(*) AS runs, count(*) FILTER (NOT success) AS failed, CAST(sum(coalesce(len(new_files), 0)) AS BIGINT) AS new, CAST(sum(coalesce(len(updated_files), 0)) AS BIGINT) AS updated,
  CAST(sum(coalesce(len(deleted_files), 0)) AS BIGINT) AS deleted FROM r GROUP BY ALL""",
    "resolve_path_priority": f"""
WITH f AS (SELECT DISTINCT site, regexp_replace(file_key, '^[^/]*/', '') AS base, {_STORED} AS extension FROM index_entry WHERE file_key IS NOT NULL)
SELECT site, base, arg_min(extension, r) AS extension FROM (SELECT *, list_position([{", ".join(f"'{e}'" for e in U.PATH_PRIORITY)}], extension) AS r FROM f) WHERE r > 0 GROUP BY ALL""",
    "status_order": _S + """, n AS (SELECT DISTINCT site, unnest(new_files) AS file_key FROM crawl_result WHERE snapshot_no = 4), u AS (SELECT DISTINCT site, unnest(updated_files) AS file_key FROM crawl_result WHERE snapshot_no = 4),
l AS (SELECT s.site, s.file_key, CASE WHEN n.site IS NOT NULL THEN 'new' WHEN u.site IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS status
      FROM s LEFT JOIN n ON s.site = n.site AND s.file_key = n.file_key LEFT JOIN u ON s.site = u.site AND s.file_key = u.file_key WHERE snapshot_no = 4)
SELECT *, CASE status WHEN 'new' THEN 0 WHEN 'updated' THEN 1 ELSE 2 END AS status_rank FROM l""",
    "plain_preview": _D + f""",
e AS (SELECT stored_id, content, ltrim(lower(regexp_extract(regexp_replace(regexp_extract(coalesce(url, ''), '{_RE}', 3), ';[^/]*$', ''), '(\\.[^./]*)$', 1)), '.') AS ext FROM d WHERE content IS NOT NULL)
SELECT stored_id, md5(CASE WHEN ext IN ('json', 'xml', 'yaml', 'yml', 'csv') THEN '```' || CASE ext WHEN 'yml' THEN 'yaml' ELSE ext END || chr(10) || content || chr(10) || '```' ELSE content END) AS wrapped,
  md5('<pre>' || replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</pre>') AS preview FROM e""",
}
