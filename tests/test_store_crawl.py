"""Statuses, link graph, logs, streams and file sources."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loam.operators import crawl as C
from loam.operators import logs as L
from loam.operators import store as S
from loam.plans import crawl_queries as Q
from loam.sources import documents as D
from loam.streaming import log_stream as G


def test_batch_status_and_upsert(spark):
    index = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2"), ("s", "c", None)], "site string, file_key string, md5 string")
    batch = spark.createDataFrame([("s", "a", "1"), ("s", "b", "3"), ("s", "d", "4")], "site string, file_key string, md5 string")
    assert {x.file_key: x.status for x in S.batch_status(batch, index).collect()} == {"a": "unchanged", "b": "updated", "d": "new"}
    assert {x.file_key: x.status for x in S.batch_status(batch, index, True).collect()}["c"] == "deleted"
    assert {x.file_key: x.md5 for x in S.upsert(index, batch).collect()} == {"a": "1", "b": "3", "c": None, "d": "4"}
    assert S.batch_status(batch.where("false"), index).count() == 0
    with pytest.raises(ValueError):
        S.without_site(index, "../x")


def test_status_rank(spark):
    df = spark.createDataFrame([(s,) for s in ("unchanged", "new", "error", "updated", "odd")], "s string")
    assert [x.s for x in df.orderBy(S.status_rank(F.col("s"))).collect()] == ["new", "updated", "unchanged", "error", "odd"]


def test_resolved_path(spark):
    df = spark.createDataFrame([("s", "x", ".html"), ("s", "x", ".md"), ("s", "y", ".tex"), ("s", "z", ".odd")], "site string, base string, extension string")
    assert {x.base: x.extension for x in S.resolved_path(df).collect()} == {"x": ".md", "y": ".tex"}


def test_breadth_first(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "f")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    walk = lambda depth, cap: {x.url: x.depth for x in C.breadth_first(edges, seeds, depth, cap).collect()}
    assert walk(9, None) == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3, "f": 4}
    assert walk(1, None) == {"a": 0, "b": 1, "c": 1}
    assert walk(9, 2) == {"a": 0, "b": 1}
    stats = C.depth_statistics(C.breadth_first(edges, seeds, 2, None))
    assert [tuple(x) for x in stats.orderBy("depth").collect()] == [(0, 1, 1), (1, 2, 3), (2, 1, 4)]
    assert C.estimated_total(stats, 2).first()[0] == 3 and C.estimated_total(stats, 999).first()[0] == 4


def test_markdown_links(spark):
    df = spark.createDataFrame([("https://h.com/a/b.html", "[x](/c/) [y](d?q=1) [z](#top) [w](https://g.com/e) [v](mailto:x) [u](//h.com/f)")], "url string, content string")
    assert {x.dst for x in C.markdown_links(df).collect()} == {"https://h.com/c", "https://h.com/a/d?q=1", "https://h.com/f"}


def test_link_frontier_follows_all_links(spark, tmp_path):
    """A cycle, a hub, two sites and links to pages that are not stored; a walk without a bound of levels goes to the end."""
    hub = " ".join(f"[l](/leaf{i})" for i in range(40))
    pages = [("https://a.com/p0", f"[n](/p1) {hub}"), ("https://a.com/p1", "[back](/p0) [x](https://b.com/q) [new](/gone?x=1#top)"), ("https://b.com/q/", "[n](r)"), (None, "[n](/no)"), ("https://b.com/none", None)]
    spark.createDataFrame(pages, "url string, content string").write.parquet(f"{tmp_path}/page_text.parquet")
    got = {x.url: x.depth for x in Q.link_frontier(spark, str(tmp_path)).collect()}
    stored = {"https://a.com/p0", "https://a.com/p1", "https://b.com/q", "https://b.com/none"}
    linked = {f"https://a.com/leaf{i}" for i in range(40)} | {"https://a.com/gone?x=1", "https://b.com/q/r"}
    assert got == {u: 0 for u in stored} | {u: 1 for u in linked}
    assert [tuple(x) for x in Q.link_depth_stats(spark, str(tmp_path)).orderBy("depth").collect()] == [(0, 4, 4), (1, 42, 46)]
    chain = spark.createDataFrame([(f"{i:02}", f"{i + 1:02}") for i in range(12)] + [("12", "00")], "src string, dst string")
    walk = C.breadth_first(chain, spark.createDataFrame([("00",)], "url string"), None, None)
    assert {x.url: x.depth for x in walk.collect()} == {f"{i:02}": i for i in range(13)}


LINES = ["[0] (1/10) Crawling: https://h/a", "  -> New: s/a", "note", "  -> Error: no: luck", "  -> [skip] URL year 2019 < 2024: https://h/b", "  -> Updated: s/b", "  -> Unchanged: s/c", "  -> Error after 3"]
WANT = [("info", "", "https://h/a"), ("new", "s/a", "https://h/a"), ("info", "", ""), ("error", "", ""), ("skip", "", "https://h/b"), ("updated", "s/b", "https://h/b"), ("unchanged", "s/c", "https://h/b"), ("info", "", "")]


def test_log_lines(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(LINES)], "run_id long, line_no int, line string")
    assert [(x.status, x.file_name, x.url) for x in L.parsed(df).orderBy("line_no").collect()] == WANT


def test_log_stream_gives_the_same(spark, tmp_path):
    rows = [(run, i, x) for run in (1, 2) for i, x in enumerate(LINES)]
    spark.createDataFrame(rows[:11], "run_id long, line_no int, line string").coalesce(1).write.parquet(f"{tmp_path}/t/lines.parquet")
    stream = G.file_stream(spark, f"{tmp_path}/t", "lines.parquet")
    G.appended(G.parsed_stream(stream), str(tmp_path), "out")
    spark.createDataFrame(rows[11:], "run_id long, line_no int, line string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t/lines.parquet")
    out = G.appended(G.parsed_stream(stream), str(tmp_path), "out")  # goes on with the address of run 2
    for run in (1, 2):
        got = [(x.status, x.file_name, x.url) for x in out.where(F.col("run_id") == run).orderBy("line_no").collect()]
        assert got == WANT


def test_stream_store_merges_all_snapshots(spark, tmp_path):
    rows = [(1, 1, "a", "1"), (2, 1, "b", "2"), (3, 1, "c", None), (4, 1, "a", "9")]  # within a snapshot the last entry holds
    rows += [(5, 2, "a", "9"), (6, 2, "b", "3"), (7, 2, "d", "4"), (8, 2, None, "5")]
    rows += [(9, 5, "b", "3"), (10, 5, "c", None), (11, 5, "d", "6"), (12, None, "z", "7")]  # c is compared with snapshot 1
    df = spark.createDataFrame([(e, n, "s", k, m, None) for e, n, k, m in rows], "entry_id long, snapshot_no int, site string, file_key string, md5 string, fetch_date string")
    df.repartition(3).write.parquet(f"{tmp_path}/index_entry.parquet")
    got = {(x.batch, x.status): x.files for x in Q.stream_store_snapshots(spark, str(tmp_path)).collect()}
    assert got == {(0, "new"): 3, (1, "unchanged"): 1, (1, "updated"): 1, (1, "new"): 1, (2, "unchanged"): 1, (2, "updated"): 2}


def test_discovery_lines(spark):
    df = spark.createDataFrame([(1, 0, "  [pre-crawl] depth=2 found=31 (doc) https://h/x"), (1, 1, "  [pre-crawl] depth=x found=4 done"), (1, 2, "other")], "run_id long, line_no int, line string")
    assert [tuple(x)[2:] for x in L.discovery(df).orderBy("line_no").collect()] == [(2, 31, True, "https://h/x"), (0, 4, False, "")]


def test_site_folders(spark, tmp_path):
    for site in ("a.com", "站点"):
        (tmp_path / site / "meta").mkdir(parents=True)
        (tmp_path / site / "index.json").write_text(json.dumps({"file_tree": {"x": {"md5": "1", "title": "T"}, "y": {"file_size": 3}}}))
        (tmp_path / site / "meta" / "x.json").write_text(json.dumps({"md5": "1"}))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "index.json").write_text("{no")
    rows = {x.file_key: (x.md5, x.title, x.file_size) for x in D.site_indexes(spark, str(tmp_path)).collect()}
    assert rows == {f"{s}/{k}": v for s in ("a.com", "站点") for k, v in (("x", ("1", "T", None)), ("y", (None, None, 3)))}
    assert {x.file_key for x in D.site_metadata(spark, str(tmp_path)).collect()} == {"a.com/x", "站点/x"}


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = archive(word__document_xml=f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Te</w:t><w:t>xt</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc/></w:tr><w:tr><w:tc/></w:tr></w:tbl></w:body></w:document>')
N = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
XLSX = archive(xl__workbook_xml=f'<workbook {N}><sheets><sheet name="S"/></sheets></workbook>', xl__sharedStrings_xml=f"<sst {N}><si><t>word</t></si></sst>", xl__worksheets__sheet1_xml=f'<worksheet {N}><sheetData><row><c r="A1"><v>2.0</v></c><c r="C1" t="s"><v>0</v></c></row><row/></sheetData></worksheet>')


def test_office_documents(spark):
    files = [("d.docx", ".docx", DOCX), ("x.xlsx", ".xlsx", XLSX), ("b.docx", ".docx", b"no zip"), ("o.odd", ".odd", b"")]
    df = spark.createDataFrame([(p, e, bytearray(c)) for p, e, c in files], "path string, extension string, content binary")
    got = {x.path: (x.markdown, x.error) for x in D.converted(df).collect()}
    assert got["d.docx"] == ("## Head\n\nText\n\n- item\n\n| a\\|b |  |\n| --- | --- |\n|  |  |", None)
    assert got["x.xlsx"] == ("## S\n\n| 2 |  | word |\n| --- | --- | --- |", None)
    assert got["b.docx"][0] is None and "BadZipFile" in got["b.docx"][1] and got["o.odd"][0] is None
