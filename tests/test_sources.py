"""Files as rows, site indexes out and in again, versions of the store."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loam.functions.urls import with_scheme
from loam.operators import crawl as C
from loam.operators import store as S
from loam.sources import documents as D
from loam.sources import scratch


def test_local_files(spark, tmp_path):
    for name, body in (("b.HTML", b"<p>"), ("sub/a.pdf", b"%PDF"), ("sub/c.bin", b"x"), ("d.md", b"#"), ("empty.md", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    rows = {x.path.rpartition("/")[2]: (x.extension, bytes(x.content)) for x in D.local_files(spark, str(tmp_path)).collect()}
    assert rows == {"b.HTML": (".html", b"<p>"), "a.pdf": (".pdf", b"%PDF"), "d.md": (".md", b"#")}
    assert [x.path.rpartition("/")[2] for x in D.local_paths(spark, str(tmp_path)).collect()] == ["b.HTML", "d.md", "a.pdf"]
    assert D.local_files(spark, str(tmp_path), (".bin",)).count() == 1


def test_site_indexes_come_back(spark, tmp_path):
    rows = [("a.example", "a.example/x y", "1f", "2024-01-02", "https://a.example/x", "T", 5, "text/html"), ("b.example", "b.example/z", None, None, None, None, None, None)]
    schema = "site string, file_key string, md5 string, fetch_date string, source_url string, title string, file_size long, content_type string"
    D.export_site_indexes(spark.createDataFrame(rows, schema), str(tmp_path / "out"))
    for folder in (tmp_path / "out").glob("site=*"):
        own = tmp_path / "in" / folder.name.removeprefix("site=")
        own.mkdir(parents=True)
        (own / "index.json").write_text("".join(p.read_text() for p in folder.glob("*.txt")))
    got = D.site_indexes(spark, str(tmp_path / "in")).drop("last_updated")
    assert sorted(map(tuple, got.select(schema.replace(" string", "").replace(" long", "").split(", ")).collect()), key=str) == sorted(rows, key=str)


def test_versions_of_the_index(spark, tmp_path):
    index = spark.createDataFrame([("hot", f"hot/{i}", "m") for i in range(400)] + [("s", "s/1", None)], "site string, file_key string, md5 string")
    path = S.write_index(index, str(tmp_path), 3)
    assert path.endswith("version=00000003")
    assert sorted(map(tuple, spark.read.parquet(path).select("site", "file_key", "md5").collect()), key=str) == sorted(map(tuple, index.collect()), key=str)
    assert 1 <= len(list((tmp_path / "version=00000003" / "site=hot").glob("*.parquet"))) <= S.WRITERS
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        S.write_index(index, str(tmp_path), 3)


def test_scheme_and_scope(spark):
    got = [x[0] for x in spark.createDataFrame([("a.example/x",), ("http://b.example",), ("file:///c",)], "u string").select(with_scheme(F.col("u"))).collect()]
    assert got == ["https://a.example/x", "http://b.example", "file:///c"]
    edges = spark.createDataFrame([("s", u) for u in ("https://a.example/d/1.html", "https://a.example/e/1.html", "https://a.example/e/1.pdf", "https://b.example/1.pdf")], "src string, dst string")
    assert {x.dst for x in C.scoped(edges, ["https://a.example/d"], [".pdf"]).collect()} == {"https://a.example/d/1.html", "https://a.example/e/1.pdf"}


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_folder(Session())
    assert scratch.shared_folder(spark)
    path = scratch.scratch_path(spark, "kept")
    spark.range(3).write.parquet(path)
    assert scratch.exists(spark, path) and scratch.changed_at(spark, path) > 0
    scratch.release(spark)
    assert not scratch.exists(spark, path)
