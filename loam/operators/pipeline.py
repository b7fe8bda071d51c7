"""A crawl as a loop over levels: fetch, filter, convert, follow links, compare with the store, and go on.

Each level is a few joins over the level's pages. What a level fetched is written once to the shared folder, so that no
address is asked twice, and a lost executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.html import html_page, is_hub
from loam.functions.text import front_matter, max_year, plain_wrapped
from loam.functions.urls import extension_of, filename_of, followable, kind_of, normalize_url, should_process, site_of
from loam.operators.crawl import PAGE_CAP, links_of
from loam.operators.store import batch_status, content_hash, upsert
from loam.sources.scratch import stored

#: Gives the pages of a frontier (url, depth): url, status, content_type, body, text, error.
Source = Callable[[DataFrame], DataFrame]
INDEX = "site string, file_key string, md5 string, fetched_at timestamp"


@dataclass
class Crawl:
    """What a crawl gives."""

    pages: DataFrame  # every address that was asked: url, depth, kind, error, year, hub, kept
    documents: DataFrame  # site, file_key, url, title, content, md5, depth
    statuses: DataFrame  # site, file_key, md5, status
    index: DataFrame  # the store's index after the crawl: site, file_key, md5, fetched_at


def read_pages(fetched: DataFrame) -> DataFrame:
    """Fetched pages (url, content_type, body, text, depth, error) with what they say: kind, title, content, links, hub.

    Pages of HTML have links, and texts have those written as in Markdown; data files are fenced; binary ones have no content here (``converted`` of the
    sources reads them), nor have those with an error.
    """
    ok = F.col("error").isNull()
    kind = F.when(ok, kind_of(F.col("url"), F.col("content_type")))
    page = html_page(F.when(kind == "html", F.col("text")), F.col("url"))
    read = fetched.withColumn("kind", F.coalesce(kind, F.lit("error"))).withColumn("_page", page)
    text = plain_wrapped(F.col("text"), F.regexp_replace(extension_of(F.col("url")), r"^\.", ""))
    return read.select(
        "url", "depth", "kind", "error", "body", "text",
        F.col("_page.true_title").alias("title"),
        F.when(F.col("kind") == "html", F.col("_page.markdown")).when(F.col("kind") == "text", text).alias("content"),
        F.when(F.col("kind") == "html", F.col("_page.links")).when(F.col("kind") == "text", links_of(F.col("text"), F.col("url"))).otherwise(F.array().cast("array<string>")).alias("links"),
        F.coalesce(is_hub(F.col("_page")), F.lit(False)).alias("hub"),
    )


def crawl(source: Source, seeds: DataFrame, index: DataFrame, extensions: list[str], bases: list[str] | None = None, max_depth: int = 3, min_year: int = 0, cap: int | None = PAGE_CAP) -> Crawl:
    """A crawl from the seeds (url) to ``max_depth``, compared with the index of an earlier one (INDEX).

    ``bases`` bound the links that are followed (none: each page's own host does). An address or content whose latest year
    is before ``min_year`` is not fetched or kept; pages of links alone (hubs) are followed and not kept. At most ``cap``
    addresses are asked, first ones of a level by name; None sets no cap. No address is asked twice. An empty table of
    seeds gives empty tables.
    """
    spark = seeds.sparkSession
    early = lambda column: F.coalesce((max_year(column) > 0) & (max_year(column) < min_year), F.lit(False))
    frontier = seeds.where("url is not null").select(normalize_url(F.col("url")).alias("url")).distinct()
    seen = asked = None
    total, levels = 0, []
    for depth in range(max_depth + 1):
        level = frontier.where(~early(F.col("url"))).withColumn("depth", F.lit(depth))
        if cap is not None:
            level = level.orderBy("url").limit(cap - total)
        level = stored(level, "crawl-level")
        n = level.count()
        if not n:
            break
        total += n
        read = read_pages(source(level).join(level, "url"))
        read = stored(read.withColumn("year", max_year(F.col("content"))), "crawl-pages")
        levels.append(read)
        asked = level if asked is None else asked.unionByName(level)
        seen = asked.select("url")
        if cap is not None and total >= cap:
            break
        found = read.select("url", F.explode("links").alias("href")).where(followable(F.col("href"))).select(F.col("url").alias("src"), normalize_url(F.col("href")).alias("url"))
        here = should_process(F.col("url"), bases, extensions) if bases else site_of(F.col("src")) == site_of(F.col("url"))
        frontier = found.where(here).select("url").distinct().join(seen, "url", "left_anti")
    if not levels:
        pages = spark.createDataFrame([], "url string, depth int, kind string, error string, body binary, text string, title string, content string, hub boolean, year int")
    else:
        pages = levels[0]
        for more in levels[1:]:
            pages = pages.unionByName(more)
    kept = F.col("content").isNotNull() & ~F.col("hub") & ~((F.col("year") > 0) & (F.col("year") < min_year)) | ((F.col("kind") == "binary") & F.col("body").isNotNull())
    pages = pages.withColumn("kept", F.coalesce(kept, F.lit(False)))
    site, name = site_of(F.col("url")), filename_of(F.col("url"))
    head = front_matter({"title": F.col("title"), "source_url": F.col("url"), "depth": F.col("depth")})
    documents = pages.where("kept").select(
        site.alias("site"), F.concat(site, F.lit("/"), name).alias("file_key"), "url", "title", "depth",
        F.concat(head, F.col("content")).alias("content"), content_hash(F.col("body"), F.col("text"), F.col("content")).alias("md5"),
    )
    # of several addresses with one file name the one that was met first
    first = stored(documents.groupBy("site", "file_key").agg(F.min(F.struct("depth", "url", "title", "content", "md5")).alias("d")).select("site", "file_key", "d.*"), "crawl-documents")
    batch = first.select("site", "file_key", "md5")
    statuses = batch_status(batch, index)
    after = upsert(index.select("site", "file_key", "md5", "fetched_at"), batch.withColumn("fetched_at", F.current_timestamp()))
    return Crawl(pages.select("url", "depth", "kind", "error", "year", "hub", "kept"), first, statuses, after)
