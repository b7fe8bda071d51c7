"""Retrieval against a plain scorer, and passages worked out by hand."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from loam.operators import retrieval as R
from loam.operators.passages import dense_blocks
from tests.test_functions import plain_tokens


def plain_scores(docs, query):
    tf = {d: Counter(plain_tokens(t)) for d, t in docs.items()}
    n, size = len(docs), {d: sum(c.values()) for d, c in tf.items()}
    mean, q = sum(size.values()) / n, plain_tokens(query)
    df = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) for t in df}
    most, out = sum(idf[t] * 2.2 for t in q if t in df), {}
    for d, c in tf.items():
        hit = [t for t in q if t in c]
        if hit:
            s = sum(idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.5 + 0.5 * size[d] / mean)) for t in hit)
            out[d] = min(1.0, s * (len(hit) / len(q)) ** 1.5 / most)
    return out


def test_scores(spark):
    r = random.Random(6)
    docs = {f"s/{i}": " ".join(r.choice(("apple", "pear", "天气", "天地好", "x1", "-")) for _ in range(r.randint(0, 12))) for i in range(60)}
    df = spark.createDataFrame([("s", d, t) for d, t in docs.items()] + [("t", "t/1", "apple"), ("t", "t/2", None)], "site string, doc string, content string")
    index = R.build_index(df)
    for query in ("apple", "apple apple zebra", "天气 pear"):
        want = plain_scores(docs, query)
        got = {x.doc: x.score for x in R.search(index, "s", query, 1000).collect()}
        assert got == pytest.approx(want, abs=1e-8)
    top = R.search(index, "s", "apple pear", 5, 0.2).orderBy("rank").collect()
    best = sorted(plain_scores(docs, "apple pear").items(), key=lambda x: (-round(x[1], 9), x[0]))[:5]
    assert [x.doc for x in top] == [d for d, s in best if s >= 0.2]
    assert R.search(index, "s", "...", 5).count() == 0 == R.search(index, "nowhere", "apple", 5).count()


def test_single_document(spark):
    index = R.build_index(spark.createDataFrame([("s", "s/1", "a")], "site string, doc string, content string"))
    assert R.search(index, "s", "a", 1).first().score == pytest.approx(1 / 2.2, abs=1e-9)
    assert R.search(index, "s", "a zzz", 1).first().score == pytest.approx(0.160706087, abs=1e-8)


def test_dense_blocks(spark):
    cases = [
        (1, "\n".join({1: "alpha", 6: "beta alpha", 12: "alpha"}.get(i, "x") for i in range(1, 13)), ["alpha", "beta"], (1, 6)),
        (2, "x\nother\ny", ["the"], (2, 2)),
        (3, "a\nb", ["zzz"], (0, 0)),
        (4, "\n".join(["k"] * 20), ["k"], (1, 11)),
        (5, "\n".join(["k"] * 10 + ["k m"] + ["k"] * 10), ["k", "m"], (6, 21)),
        (6, None, ["k"], (0, 0)),
        (7, "", ["k"], (0, 0)),
    ]
    df = spark.createDataFrame([(i, c, t) for i, c, t, _ in cases], "id long, content string, tokens array<string>")
    got = {x.id: x for x in dense_blocks(df, ["id"], "content", "tokens").collect()}
    for i, content, _, (start, end) in cases:
        assert (got[i].start_line, got[i].end_line) == (start, end), i
        assert got[i].matched_block == ("\n".join(content.split("\n")[start - 1 : end]) if start else "")


def test_answers(spark):
    docs = spark.createDataFrame([("s", "s/1", "T", "---\na: 1\n---\nfirst\nan apple\r\nlast", "u", "p")], "site string, doc string, title string, content string, url string, local_path string")
    asked = spark.createDataFrame([(7, "s", "apple", 3, None, None)], "request_id long, site string, query string, top_k int, threshold double, output_dir string")
    row = R.answers(R.ranked(R.scores(R.build_index(docs), asked), asked), asked, docs).first()
    assert (row.request_id, row.rank, row.start_line, row.matched_block, row.snippet) == (7, 1, 3, "an apple", "first an apple last")


def test_stored_index_is_refreshed_by_site(spark, tmp_path):
    schema = "site string, doc string, content string"
    first = [("s", "s/1", "apple pear"), ("s", "s/2", "pear"), ("t", "t/1", "apple"), ("u", "u/1", "plum"), (None, "x", "apple")]
    later = [("s", "s/1", "apple pear"), ("s", "s/2", "pear"), ("t", "t/1", "apple apple quince"), ("t", "t/2", "fig"), ("v", "v/1", "apple")]
    kept = R.StoredIndex(spark, str(tmp_path / "index"))
    assert kept.refresh(spark.createDataFrame(first, schema)) == 3
    assert kept.refresh(spark.createDataFrame(first, schema)) == 0
    assert kept.refresh(spark.createDataFrame(later, schema)) == 3  # t changed, u gone, v new
    index, fresh = R.StoredIndex(spark, str(tmp_path / "index")).index(), R.build_index(spark.createDataFrame(later, schema))
    for name in ("postings", "documents", "terms", "sites"):
        a, b = getattr(index, name), getattr(fresh, name)
        assert sorted(map(tuple, a.select(sorted(a.columns)).collect())) == sorted(map(tuple, b.select(sorted(b.columns)).collect())), name
    assert [x.doc for x in R.search(index, "t", "quince", 5).collect()] == ["t/1"]
    assert R.search(index, "u", "plum", 5).count() == 0
    assert R.StoredIndex(spark, str(tmp_path / "none")).refresh(spark.createDataFrame([], schema)) == 0


def test_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    rows = [("s", f"s/{i}", f"word{i} apple") for i in range(50)]
    kept = R.StoredIndex(spark, str(tmp_path))
    kept.refresh(spark.createDataFrame(rows, "site string, doc string, content string"))
    found = R.search(kept.index(), "s", "word7", 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket), ", "").replace("PartitionFilters: [isnotnull(bucket#", "PartitionFilters: [bucket#") and "WindowGroupLimit" in plan
    assert [x.doc for x in found.collect()] == ["s/7"]
