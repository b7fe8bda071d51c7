"""Fetching with a stand-in for the network, and settings."""

from __future__ import annotations

import pytest

from loam.config import CrawlConfig, confined
from loam.sources import fetch as X


def stand_in(url):
    if "missing" in url:
        return 404, "text/html", b""
    if "broken" in url:
        raise OSError("no route")
    return 200, "text/html; charset=ISO-8859-1", "<meta charset='gbk'>中文".encode("gbk")


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(X, "ATTEMPTS", 1)
    df = spark.createDataFrame([("https://a/ok",), ("https://a/missing",), ("https://b/broken",), (None,)], "url string")
    got = {r.url: (r.status, r.text, r.error) for r in X.fetched(df, delay=0.0, fetch=stand_in).collect()}
    assert got["https://a/ok"] == (200, "<meta charset='gbk'>中文", None)
    assert got["https://a/missing"] == (404, None, "HTTP 404")
    assert got["https://b/broken"][0] is None and "no route" in got["https://b/broken"][2] and len(got) == 3


def test_attempts():
    answers, pauses = [(500, "", b""), (429, "", b""), (200, "t", b"x")], []
    assert X.fetched_once("https://a", lambda _: answers.pop(0), pauses.append) == (200, "t", b"x", None)
    assert pauses == [2.0, 4.0]
    with pytest.raises(ValueError):
        X.over_http("file:///etc/hosts")


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"urls": ["h.com", "http://g.com"], "max_depth": 5, "odd": 1, "delay": null}')
    config = CrawlConfig.load(tmp_path / "c.json")
    assert (config.max_depth, config.delay, config.seeds()) == (5, 1.0, ["https://h.com", "http://g.com"])
    config.save(tmp_path / "d.json")
    assert CrawlConfig.load(tmp_path / "d.json") == config


def test_confined(tmp_path):
    assert confined(tmp_path, "a/b.md").name == "b.md"
    with pytest.raises(ValueError):
        confined(tmp_path, "../x")
