"""Link graph traversal: level by level, each level one join with the edges and one anti-join with what was seen."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.urls import followable, normalize_url, part, should_process
from loam.sources.scratch import stored

PAGE_CAP = 10_000
MARKDOWN_LINK = r"\[[^\]]*\]\(([^)\s]+)\)"


def absolute(base: Column, href: Column) -> Column:
    """An address as a page at ``base`` means it: relative to the host's root or to the page's folder."""
    root = F.concat(F.lower(part(base, 1)), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(part(base, 3), "[^/]*$", "")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.lower(part(base, 1)), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, part(base, 3), href))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), href))
    )


def links_of(content: Column, url: Column) -> Column:
    """The targets of a Markdown text's links as absolute addresses, in order."""
    hrefs = F.filter(F.regexp_extract_all(content, F.lit(MARKDOWN_LINK), F.lit(1)), followable)
    return F.transform(hrefs, lambda href: absolute(url, href))


def markdown_links(pages: DataFrame) -> DataFrame:
    """Links of pages (url, content): src, dst, both normalised, once each, on the page's own host.

    Addresses relative to the host's root or to the page's folder are made absolute; ``.`` and ``..`` are followed.
    """
    found = pages.where("url is not null and content is not null").select("url", F.explode(links_of(F.col("content"), F.col("url"))).alias("to"))
    linked = found.select(normalize_url(F.col("url")).alias("src"), normalize_url(F.col("to")).alias("dst"))
    return linked.where(part(F.col("src"), 2) == part(F.col("dst"), 2)).distinct()


def breadth_first(edges: DataFrame, seeds: DataFrame, max_depth: int | None, cap: int | None = PAGE_CAP) -> DataFrame:
    """Nodes reached from the seeds (url) along edges (src, dst) with their least depth: url, depth.

    Ends after ``max_depth`` levels (None: no bound), at the first empty one, or with the level that reaches ``cap`` nodes; of that level
    the first by name are kept, so that the result has ``cap`` nodes. No cap: None.
    """
    seen = stored(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "crawl-seen")
    frontier, total = seen, seen.count()
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        if cap is not None and total >= cap:
            break
        reached = frontier.join(edges, frontier["url"] == edges["src"]).select(F.col("dst").alias("url")).distinct()
        fresh = reached.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth))
        frontier = stored(fresh, "crawl-level")
        n = frontier.count()
        if not n:
            break
        total += n
        seen = seen.unionByName(frontier)
    return seen if cap is None else seen.orderBy("depth", "url").limit(cap)


def scoped(edges: DataFrame, bases: list[str], extensions: list[str]) -> DataFrame:
    """The edges that a crawl of ``bases`` follows."""
    return edges.where(should_process(F.col("dst"), bases, extensions))


def depth_statistics(frontier: DataFrame) -> DataFrame:
    """Per depth: nodes, and nodes up to it. Depths without nodes are filled in; there are few depths."""
    counts = frontier.groupBy("depth").agg(F.count(F.lit(1)).alias("urls"))
    all_depths = counts.agg(F.max("depth").alias("m")).select(F.explode(F.sequence(F.lit(0), "m")).alias("depth"))
    filled = all_depths.join(counts, "depth", "left").select("depth", F.coalesce("urls", F.lit(0)).alias("urls"))
    return filled.withColumn("cumulative", F.sum("urls").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)))


def estimated_total(statistics: DataFrame, max_depth: int) -> DataFrame:
    """How many pages a crawl to ``max_depth`` is expected to meet: total (999 and more: all that were discovered)."""
    last = F.max("cumulative")
    if max_depth >= 999:
        return statistics.agg(last.alias("total"))
    at = F.max(F.when(F.col("depth") == max_depth - 1, F.col("cumulative")))
    return statistics.agg(F.coalesce(at, last).alias("total"))
