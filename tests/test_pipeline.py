"""The crawl loop over a small stand-in site."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from loam.functions.text import front_matter
from loam.functions.urls import normalize_url
from loam.operators import pipeline as P
from loam.sources.fetch import fetched

TEXT = "<p>The committee met, read the report, and found no fault with it. The minutes are public, as always.</p>"
SITE = {
    "https://a.example/": f"<title>Start</title><div class=content>{TEXT} 2024年 <a href='one.html'>one</a> <a href='/two.md'>two</a> <a href='https://b.example/x.html'>away</a> <a href='/2011/05/old.html'>old</a></div>",
    "https://a.example/one.html": f"<title>One</title><div class=content>{TEXT}<a href='../one.html#top'>self</a> <a href='sub/../three.html'>three</a> <a href='/file.pdf'>pdf</a></div>",
    "https://a.example/two.md": "# Two\n[four](./four.json) [gone](/gone.html) 2023-04",
    "https://a.example/three.html": "<title>Hub</title>" + "".join(f"<a href='/l{i}.html'>a long link text {i}</a>" for i in range(3)),
    "https://a.example/four.json": "{}",
    "https://a.example/l0.html": f"<title>L</title><div class=content>{TEXT} 2012年 notes</div>",
}
KINDS = {"md": "text/markdown", "json": "application/json", "pdf": "application/pdf"}


def page(url):
    if url.endswith(".pdf"):
        return 200, "application/pdf", b"%PDF"
    if url not in SITE:
        return 404, "text/html", b""
    return 200, KINDS.get(url.rpartition(".")[2], "text/html"), SITE[url].encode()


def crawled(spark, seeds, index=(), **options):
    source = partial(fetched, delay=0.0, fetch=page)
    df = spark.createDataFrame([(s,) for s in seeds], "url string")
    return P.crawl(source, df, spark.createDataFrame(list(index), P.INDEX), [".html", ".md", ".json", ".pdf"], **options)


def test_levels_filters_and_statuses(spark):
    first = crawled(spark, ["https://a.example", "https://a.example/", None], max_depth=3, min_year=2015)
    pages = {x.url: x for x in first.pages.collect()}
    depth = {u.removeprefix("https://a.example"): x.depth for u, x in pages.items()}
    assert depth == {"/": 0, "/one.html": 1, "/two.md": 1, "/three.html": 2, "/file.pdf": 2, "/four.json": 2, "/gone.html": 2, "/l0.html": 3, "/l1.html": 3, "/l2.html": 3}
    assert pages["https://a.example/gone.html"].error == "HTTP 404" and pages["https://a.example/gone.html"].kind == "error"
    assert pages["https://a.example/three.html"].hub and not pages["https://a.example/three.html"].kept
    assert not pages["https://a.example/l0.html"].kept  # an old text
    docs = {x.file_key: x for x in first.documents.collect()}
    assert set(docs) == {"a.example/index", "a.example/one_html", "a.example/two_md", "a.example/file_pdf", "a.example/four_json"}
    assert docs["a.example/two_md"].content.startswith("---\nsource_url: https://a.example/two.md\ndepth: 1\n---\n\n# Two")
    assert docs["a.example/four_json"].content.endswith("```json\n{}\n```") and docs["a.example/file_pdf"].content is None
    assert {x.status for x in first.statuses.collect()} == {"new"}
    known = [(x.site, x.file_key, x.md5 if "one" in x.file_key else "other", None) for x in first.statuses.collect() if "two" not in x.file_key]
    again = crawled(spark, ["https://a.example/"], known, max_depth=1)
    assert {x.file_key: x.status for x in again.statuses.collect()} == {"a.example/index": "updated", "a.example/one_html": "unchanged", "a.example/two_md": "new"}
    assert again.index.count() == 5


def test_cap_scope_and_no_seeds(spark):
    assert crawled(spark, ["https://a.example/"], cap=2).pages.count() == 2
    scoped = crawled(spark, ["https://a.example/"], bases=["https://a.example/sub"], max_depth=1)
    assert {x.url for x in scoped.pages.collect()} == {"https://a.example/", "https://a.example/one.html", "https://a.example/two.md", "https://a.example/2011/05/old.html"}
    none = crawled(spark, [])
    assert none.pages.count() == none.documents.count() == none.statuses.count() == 0


def test_dot_segments(spark):
    urls = ["http://h.test/a/../b", "http://h.test/a/./b/", "http://h.test/../../x", "http://h.test/a/b/..", "http://h.test/a..b/c", "http://h.test/a/b/../../"]
    got = [x[0] for x in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(normalize_url(F.col("u"))).collect()]
    assert got == ["http://h.test/b", "http://h.test/a/b", "http://h.test/x", "http://h.test/a", "http://h.test/a..b/c", "http://h.test/"]


def test_front_matter(spark):
    row = spark.range(1).select(front_matter({"title": F.lit("a\nb"), "none": F.lit(None).cast("string"), "n": F.lit(3)}).alias("f")).first()
    assert row.f == "---\ntitle: a b\nn: 3\n---\n\n"
