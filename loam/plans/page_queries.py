"""Registered queries over HTML pages, layouts and highlight windows.

The given tables hold no HTML; the pages are rendered from page_text by Spark, line by line, and then parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.html import html_page, is_hub
from loam.functions.layout import highlight_window, layout_to_markdown
from loam.functions.text import tokens
from loam.sources.scratch import stored
from loam.sources.tables import read_table


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _line(line: Column) -> Column:
    """A line of text as an element."""
    shown = F.regexp_replace(_escaped(F.trim(F.regexp_replace(line, "\r", ""))), r"\[([^\]]*)\]\(([^)]*)\)", '<a href="$2">$1</a>')
    cells = F.transform(F.split(F.regexp_replace(shown, r"^\|\s*|\s*\|$", ""), r"\s*\|\s*"), lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>")))
    return (
        F.when(shown == "", "")
        .when(shown.rlike(r"^\|[-| ]*\|$"), "")
        .when(shown.rlike(r"^\|.*\|$"), F.concat(F.lit("<table><tr>"), F.array_join(cells, ""), F.lit("</tr></table>")))
        .when(shown.rlike(r"^[-*] "), F.concat(F.lit("<li>"), F.call_function("substring", shown, F.lit(3), F.length(shown)), F.lit("</li>")))
        .when(shown.rlike(r"^#+ "), F.concat(F.lit("<h3>"), F.regexp_replace(shown, "^#+ ", ""), F.lit("</h3>")))
        .otherwise(F.concat(F.lit("<p>"), shown, F.lit("<p>")))
    )


def rendered(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as HTML: page_id, title, url, html."""
    pages = read_table(spark, folder, "page_text").where("content is not null").dropDuplicates(["page_id"])
    head = F.concat(F.lit("<html><head><title>"), _escaped(F.coalesce("title", F.lit(""))), F.lit("</title><style>p {}</style><script>'</p>'</script></head><body><div class=content>"))
    body = F.array_join(F.transform(F.split("content", "\n"), _line), "\n")
    return pages.select("page_id", "title", "url", F.concat(head, body, F.lit("</div></body></html>")).alias("html"))


def parsed_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = rendered(spark, folder)
    return stored(pages.select("page_id", html_page("html", "url").alias("p")), "parsed-pages")


def page_titles(spark: SparkSession, folder: str) -> DataFrame:
    return parsed_pages(spark, folder).select("page_id", F.col("p.title").alias("title"))


def html_links(spark: SparkSession, folder: str) -> DataFrame:
    return parsed_pages(spark, folder).select("page_id", F.size("p.links").alias("links"))


def hub_pages(spark: SparkSession, folder: str) -> DataFrame:
    return parsed_pages(spark, folder).where(is_hub(F.col("p"))).select("page_id")


def page_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return parsed_pages(spark, folder).select("page_id", "p.true_title", "p.markdown")


def layout_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Each page's lines set on paper (title large, table cells side by side, others one below the other) and read back."""
    pages = read_table(spark, folder, "page_text").where("content is not null").dropDuplicates(["page_id"])
    cells = lambda line: F.filter(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: ~c.rlike("^[- ]*$"))
    placed = F.flatten(F.transform(F.split("content", "\n"), lambda line, i: F.transform(cells(line), lambda c, j: F.struct(
        F.trim(c).alias("text"), F.when(F.trim(line) == F.col("title"), 16.0).otherwise(10.5).alias("size"), (i * 12.0 + 50).alias("y0"), (j * 120.0 + 60).alias("x0")))))
    lines = stored(pages.select("page_id", placed.alias("lines")), "layout-lines")
    return lines.select("page_id", layout_to_markdown("lines").alias("markdown"))


def answer_windows(spark: SparkSession, folder: str) -> DataFrame:
    """For every answer, where in its document's text most of the request's words stand."""
    results = read_table(spark, folder, "search_result").select("result_id", "request_id", F.col("filename").alias("file_key")).distinct()
    asked = read_table(spark, folder, "search_request").select("request_id", "query").distinct()
    docs = read_table(spark, folder, "stored_doc").where("content is not null").dropDuplicates(["stored_id"]).select("file_key", "content")
    found = results.join(asked, "request_id").join(docs, "file_key").withColumn("w", highlight_window("content", tokens(F.col("query"))))
    return found.select("result_id", "w.start", "w.end")


QUERIES = {f.__name__: f for f in (page_titles, html_links, hub_pages, page_markdown, layout_rows, answer_windows)}
SQL = {
    "page_titles": r"""
WITH p AS (SELECT DISTINCT ON (page_id) page_id, title FROM page_text WHERE content IS NOT NULL ORDER BY page_id)
SELECT page_id, coalesce(nullif(trim(regexp_replace(title, '[\s\x{a0}\x{3000}]+', ' ', 'g')), ''), 'Untitled') AS title FROM p""",
    "html_links": r"""
WITH p AS (SELECT DISTINCT ON (page_id) page_id, content FROM page_text WHERE content IS NOT NULL ORDER BY page_id),
h AS (SELECT page_id, trim(h) AS href FROM (SELECT page_id, unnest(regexp_extract_all(content, '\[[^\]\n]*\]\(([^)\n]*)\)', 1)) AS h FROM p))
SELECT p.page_id, CAST(count(DISTINCT href) FILTER (href <> '' AND NOT regexp_matches(href, '^(javascript:|mailto:|tel:|#)')) AS INTEGER) AS links FROM p LEFT JOIN h USING (page_id) GROUP BY ALL""",
}
