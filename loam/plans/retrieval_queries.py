"""Registered queries of the retrieval and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.text import front_matter_map, highlight_terms, snippet, strip_front_matter, tokens
from loam.operators import retrieval as R
from loam.operators.passages import dense_blocks
from loam.sources.scratch import changed_at, scratch_path, stored
from loam.sources.tables import read_table

QUERY = "学历证明 application portal"
SITE = "www.zhikao-hub.example"


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The stored documents, one row each: site, doc, title, content, url, local_path."""
    docs = read_table(spark, folder, "stored_doc").dropDuplicates(["stored_id"])
    return docs.select("site", F.col("file_key").alias("doc"), "title", "content", "url", "local_path")


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """The search requests, one row each: of one that was sent twice, the first."""
    row = F.struct("requested_at", "query", "site_name", "top_k", "threshold", "output_dir")
    rows = read_table(spark, folder, "search_request").groupBy("request_id").agg(F.min(row).alias("r"))
    return rows.select("request_id", F.col("r.site_name").alias("site"), "r.query", "r.top_k", "r.threshold", "r.output_dir")


_indexes: dict[tuple[str, str, int], str] = {}


def kept_index(spark: SparkSession, folder: str) -> R.SearchIndex:
    """The index of the stored documents: built by the first query of an application, read by later ones as long as the
    table's files do not change."""
    key = (spark.sparkContext.applicationId, folder, changed_at(spark, f"{folder}/stored_doc.parquet"))
    if key not in _indexes:
        path = scratch_path(spark, "search-index", keep=True)
        R.StoredIndex(spark, path).refresh(corpus(spark, folder))
        _indexes[key] = path
    return R.StoredIndex(spark, _indexes[key]).index()


def tokenize_docs(spark: SparkSession, folder: str) -> DataFrame:
    cut = corpus(spark, folder).where("content is not null").select("doc", tokens(strip_front_matter(F.col("content"))).alias("t"))
    return cut.select("doc", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"), F.md5(F.array_join("t", " ")).alias("digest"))


def term_freq(spark: SparkSession, folder: str) -> DataFrame:
    return R.build_index(corpus(spark, folder)).postings.select("doc", "term", "tf")


def doc_freq_idf(spark: SparkSession, folder: str) -> DataFrame:
    return R.build_index(corpus(spark, folder)).terms.select("site", "term", "df", F.round("idf", 6).alias("idf"))


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return R.build_index(corpus(spark, folder)).sites.select("site", "n", F.round("avgdl", 6).alias("avgdl"))


def bm25_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Every request answered over its site: the ranked documents."""
    asked = stored(requests(spark, folder), "requests")
    found = R.ranked(R.scores(kept_index(spark, folder), asked), asked)
    return found.select("request_id", "rank", F.col("doc").alias("filename"), F.round("score", 6).alias("score"))


def bm25_search_top10(spark: SparkSession, folder: str) -> DataFrame:
    """One query asked of every site: the ten best documents of each."""
    docs = corpus(spark, folder)
    asked = docs.select("site").distinct().select(F.xxhash64("site").alias("request_id"), "site", F.lit(QUERY).alias("query"), F.lit(10).alias("top_k"), F.lit(None).cast("double").alias("threshold"))
    found = R.ranked(R.scores(kept_index(spark, folder), asked), asked)
    return found.select("site", "rank", F.col("doc").alias("filename"), F.round("score", 6).alias("score"))


def bm25_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """As bm25_search_top10 with fifty documents a site, repeated and unknown terms, and a threshold."""
    docs = corpus(spark, folder)
    asked = docs.select("site").distinct().select(
        F.xxhash64("site").alias("request_id"), "site", F.lit("编号 编号 data data zzzz").alias("query"), F.lit(50).alias("top_k"), F.lit(0.05).alias("threshold")
    )
    found = R.ranked(R.scores(kept_index(spark, folder), asked), asked)
    return found.select("site", "rank", F.col("doc").alias("filename"), F.round("score", 6).alias("score"))


def search_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Every request's full answer: ranked documents with snippet, passage and links."""
    asked = stored(requests(spark, folder), "requests")
    docs = corpus(spark, folder)
    winners = R.ranked(R.scores(kept_index(spark, folder), asked), asked)
    return R.answers(winners, asked, docs).withColumn("score", F.round("score", 6))


def search_snippet(spark: SparkSession, folder: str) -> DataFrame:
    docs = corpus(spark, folder).where("content is not null")
    words = tokens(F.lit(QUERY))
    return docs.select("doc", snippet(strip_front_matter(F.col("content")), words).alias("snippet"))


def dense_passage(spark: SparkSession, folder: str) -> DataFrame:
    docs = corpus(spark, folder).where("content is not null").select("doc", strip_front_matter(F.col("content")).alias("content"), tokens(F.lit(QUERY)).alias("tokens"))
    out = dense_blocks(docs, ["doc"], "content", "tokens")
    return out.select("doc", "start_line", "end_line", F.md5("matched_block").alias("block"))


def strip_front(spark: SparkSession, folder: str) -> DataFrame:
    docs = corpus(spark, folder)
    return docs.select("doc", F.md5(strip_front_matter(F.col("content"))).alias("body"))


def front_matter_fields(spark: SparkSession, folder: str) -> DataFrame:
    docs = corpus(spark, folder).where("content is not null")
    fields = front_matter_map(F.col("content"))
    return docs.select("doc", F.try_element_at(fields, F.lit("source_url")).alias("source_url"), F.size(fields).alias("n_fields"))


def block_terms(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "search_result").where("matched_block is not null").select("result_id", "matched_block").distinct()
    return rows.select("result_id", F.explode(highlight_terms(F.col("matched_block"))).alias("term"))


_CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}]+"
_DOCS = r"""
WITH raw AS (SELECT DISTINCT ON (stored_id) stored_id, site, file_key AS doc, content FROM stored_doc ORDER BY stored_id),
body AS (SELECT site, doc, CASE WHEN starts_with(content, '---') AND strpos(substr(content, 4), chr(10) || '---') > 0
    THEN substr(content, 3 + strpos(substr(content, 4), chr(10) || '---') + 4) ELSE content END AS content FROM raw WHERE content IS NOT NULL)
"""


def _tokens_sql(text: str) -> str:
    """Tokens in SQL: runs of ideographs are set apart, then cut into pairs. RE2 knows no class of alphabetic characters;
    the Hebrew and Arabic vowel points among them are named."""
    runs = rf"regexp_extract_all(regexp_replace(lower({text}), '({_CJK})', ' \1 ', 'g'), '[\p{{L}}\p{{N}}\x{{345}}\x{{5b0}}-\x{{5bd}}\x{{5bf}}\x{{5c1}}\x{{5c2}}\x{{5c4}}\x{{5c5}}\x{{5c7}}\x{{610}}-\x{{61a}}\x{{64b}}-\x{{657}}\x{{659}}-\x{{65f}}\x{{670}}]+')"
    pairs = f"CASE WHEN regexp_full_match(r, '{_CJK}') THEN list_transform(range(1, length(r) + 1), lambda i: substr(r, i, 2)) ELSE [r] END"
    return f"flatten(list_transform({runs}, lambda r: {pairs}))"


_INDEX = _DOCS + f""",
tok AS (SELECT site, doc, {_tokens_sql('content')} AS t FROM body),
len AS (SELECT site, doc, len(t) AS dl FROM tok),
post AS (SELECT site, doc, term, count(*) AS tf FROM (SELECT site, doc, unnest(t) AS term FROM tok) GROUP BY ALL),
st AS (SELECT site, count(*) AS n, avg(dl) AS avgdl FROM len GROUP BY site),
term AS (SELECT p.site, p.term, count(*) AS df, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM post p JOIN st USING (site) GROUP BY ALL)
"""


def _ranked_sql(asked: str, columns: str) -> str:
    return _INDEX + f""",
req AS ({asked}),
qt AS (SELECT request_id, site, len(q) AS n_tokens, unnest(q) AS term FROM (SELECT request_id, site, {_tokens_sql('query')} AS q FROM req)),
q AS (SELECT request_id, site, n_tokens, term, count(*) AS qn FROM qt GROUP BY ALL),
w AS (SELECT q.*, idf, sum(qn * idf * 2.2) OVER (PARTITION BY request_id) AS most FROM q JOIN term USING (site, term)),
s AS (SELECT w.request_id, w.site, p.doc, sum(qn * idf * tf * 2.2 / (tf + 1.2 * (0.5 + 0.5 * dl / avgdl))) * pow(sum(qn) / any_value(n_tokens), 1.5) / any_value(most) AS score
      FROM w JOIN post p USING (site, term) JOIN len USING (site, doc) JOIN st USING (site) GROUP BY ALL),
r AS (SELECT request_id, site, doc, round(greatest(0, least(1, score)), 9) AS score, row_number() OVER (PARTITION BY request_id ORDER BY round(greatest(0, least(1, score)), 9) DESC, doc) AS rank FROM s WHERE score > 0)
SELECT {columns}, CAST(rank AS INTEGER) AS rank, doc AS filename, round(score, 6) AS score FROM r JOIN req USING (request_id)
WHERE rank <= top_k AND (coalesce(threshold, 0) <= 0 OR score >= threshold)"""


_WORDS = f"(SELECT list(DISTINCT x) FROM (SELECT unnest({_tokens_sql(repr(QUERY))}) AS x))"

QUERIES = {
    "bm25_search_top10": bm25_search_top10, "bm25_batch": bm25_batch, "bm25_threshold": bm25_threshold, "search_answers": search_answers, "search_snippet": search_snippet, "dense_passage": dense_passage,
    "tokenize_docs": tokenize_docs, "term_freq": term_freq, "doc_freq_idf": doc_freq_idf, "corpus_stats": corpus_stats, "strip_front_matter": strip_front, "front_matter_fields": front_matter_fields, "highlight_terms": block_terms,
}

SQL = {
    "bm25_search_top10": _ranked_sql(f"SELECT DISTINCT hash(site) AS request_id, site, '{QUERY}' AS query, 10 AS top_k, NULL AS threshold FROM raw", "r.site"),
    "bm25_threshold": _ranked_sql("SELECT DISTINCT hash(site) AS request_id, site, '编号 编号 data data zzzz' AS query, 50 AS top_k, 0.05 AS threshold FROM raw", "r.site"),
    "bm25_batch": _ranked_sql("SELECT DISTINCT ON (request_id) request_id, site_name AS site, query, top_k, threshold FROM search_request ORDER BY request_id, requested_at, query", "request_id"),
    "tokenize_docs": _INDEX + "SELECT doc, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_terms, md5(coalesce(array_to_string(t, ' '), '')) AS digest FROM tok",
    "term_freq": _INDEX + "SELECT doc, term, tf FROM post",
    "doc_freq_idf": _INDEX + "SELECT site, term, df, round(idf, 6) AS idf FROM term",
    "corpus_stats": _INDEX + "SELECT site, n, round(avgdl, 6) AS avgdl FROM st",
    "search_snippet": _DOCS + f""",
t AS (SELECT doc, content, list_filter({_tokens_sql(repr(QUERY))}, lambda x: strpos(lower(content), x) > 0) AS f FROM body),
p AS (SELECT doc, content, greatest(CASE WHEN len(f) > 0 THEN strpos(lower(content), f[1]) - 1 ELSE 0 END - 30, 0) AS s FROM t)
SELECT doc, CASE WHEN s > 0 THEN '...' ELSE '' END || regexp_replace(replace(replace(substr(content, s + 1, 120), chr(10), ' '), chr(13), ''),
  '^[\\s\\x{{0b}}\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+|[\\s\\x{{0b}}\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+$', '', 'g') || CASE WHEN s + 120 < length(content) THEN '...' ELSE '' END AS snippet FROM p""",
    "dense_passage": _DOCS + f""",
l AS (SELECT doc, list_transform(string_split(regexp_replace(content, '\\r?\\n$', ''), chr(10)), lambda x: regexp_replace(x, '\\r$', '')) AS ls FROM body),
e AS (SELECT doc, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS line FROM l),
w AS (SELECT {_WORDS} AS ws),
h AS (SELECT doc, line, len(list_filter((SELECT ws FROM w), lambda x: contains(lower(text), x))) AS hits FROM e),
m AS (SELECT *, max(hits) OVER (PARTITION BY doc) AS most FROM h WHERE hits > 0),
s AS (SELECT * FROM m WHERE hits >= CASE WHEN most >= 6 THEN greatest(2, most // 4) ELSE 1 END),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY line) AS cluster FROM (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY doc ORDER BY line) > 5 THEN 1 ELSE 0 END AS new FROM s)),
c AS (SELECT doc, cluster, sum(hits) AS total, min(line) AS a, max(line) AS z, arg_min(line, line - 1000000 * hits) AS peak FROM g GROUP BY ALL),
b AS (SELECT doc, a, z, peak FROM c QUALIFY row_number() OVER (PARTITION BY doc ORDER BY total DESC, a) = 1),
x AS (SELECT doc, CASE WHEN z - a + 1 > 15 THEN greatest(peak - 5, 0) ELSE a END AS a, CASE WHEN z - a + 1 > 15 THEN least(peak + 10, z) ELSE z END AS z FROM b)
SELECT l.doc, CAST(coalesce(a + 1, 0) AS INTEGER) AS start_line, CAST(coalesce(z + 1, 0) AS INTEGER) AS end_line,
       md5(coalesce(array_to_string(ls[CAST(a + 1 AS BIGINT):CAST(z + 1 AS BIGINT)], chr(10)), '')) AS block FROM l LEFT JOIN x USING (doc)""",
    "highlight_terms": r"""
WITH r AS (SELECT DISTINCT result_id, matched_block AS b FROM search_result WHERE matched_block IS NOT NULL),
c AS (SELECT result_id, regexp_replace(regexp_replace(regexp_replace(b, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<https?://[^>]*>', ' ', 'g') AS b FROM r),
w AS (SELECT result_id, list_filter(list_transform(string_split_regex(b, '[\s\x{0b}|]+'), lambda w: regexp_replace(w, '[^\x{4e00}-\x{9fa5}a-zA-Z0-9]', '', 'g')), lambda w: w <> '') AS ws FROM c),
l AS (SELECT result_id, ws, flatten(list_transform(ws, lambda w: CASE WHEN length(w) > 8 THEN list_filter(list_transform(range(0, (length(w) + 4) // 5), lambda i: substr(w, i * 5 + 1, 5)), lambda c: length(c) >= 2)
  WHEN length(w) >= 2 THEN [w] ELSE [] END)) AS long FROM w)
SELECT DISTINCT result_id, unnest(CASE WHEN len(long) > 0 THEN long ELSE ws END) AS term FROM l""",
    "strip_front_matter": _DOCS + "SELECT raw.doc, md5(body.content) AS body FROM raw LEFT JOIN body USING (doc)",
    "front_matter_fields": r"""
WITH raw AS (SELECT DISTINCT ON (stored_id) stored_id, file_key AS doc, content FROM stored_doc ORDER BY stored_id),
b AS (SELECT doc, list_filter(string_split_regex(regexp_extract(content, '^---\r?\n((?s:.)*?)\r?\n---', 1), '\r?\n'), lambda x: regexp_matches(x, '^[^:\s][^:]*:')) AS ls FROM raw WHERE content IS NOT NULL)
SELECT doc, trim(regexp_extract(list_filter(ls, lambda x: starts_with(x, 'source_url:'))[-1], '^[^:]+:\s*(.*)$', 1)) AS source_url,
       CAST(len(list_distinct(list_transform(ls, lambda x: trim(regexp_extract(x, '^([^:]+):', 1))))) AS INTEGER) AS n_fields FROM b""",
}
