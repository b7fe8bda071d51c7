"""Repeated lines against a plain count, deltas against one count from scratch, and cases at the edges."""

from __future__ import annotations

import random
import re
from collections import defaultdict

from loam.llm import repeated_lines as R

SCHEMA = "stored_id long, site string, content string, extra string"


def form(line):
    return re.sub("[0-9]+", "0", re.sub(r"\s+", "", line).upper().lower())


def plain(rows):
    docs, sites = defaultdict(set), defaultdict(set)
    for i, site, content, _ in rows:
        sites[site].add(i)
        for line in (content or "").split("\n"):
            if any(c.isalpha() for c in line):
                docs[site, form(line)].add(i)
    hit = {k for k, v in docs.items() if len(v) >= 5 and 20 * len(v) >= len(sites[k[0]])}
    return {(i, n) for i, site, content, _ in rows for n, line in enumerate((content or "").split("\n"), 1) if (site, form(line)) in hit}


def made(seed=1, n=300):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        site = "hot" if r.random() < 0.4 else r.choice("abc")
        lines = [r.choice(("Share this page", "share  THIS\tpage", f"Page {r.randint(1, 99)} of 9", f"text {r.random()} own", "", "12 34", "分享到：微友圈", "　分享到： 微友圈")) for _ in range(r.randint(0, 9))]
        rows.append((i, site, r.choice((None, "", *["\n".join(lines)] * 8)), "x"))
    return rows + rows[:20]  # repeated rows


def found(spark, rows):
    return {(x.stored_id, x.line_no) for x in R.repeated_line_occurrences(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_against_plain_count(spark):
    rows = made()
    assert found(spark, rows) == plain(rows) != set()


def test_salted_join_gives_the_same(spark, monkeypatch):
    rows = made(2)
    monkeypatch.setattr(R, "BROADCAST_LINES", 0)
    assert found(spark, rows) == plain(rows)


def test_deltas_end_where_one_count_does(spark):
    rows = made(3)
    df = spark.createDataFrame(rows, SCHEMA)
    once = R.LineCounts.empty(spark).merge(df)
    first = R.LineCounts.empty(spark).merge(df.where("stored_id < 90"))
    both = first.merge(df.where("stored_id >= 60"))  # 60 to 89 come again
    assert {x[0] for x in both.repeated().collect()} == {x[0] for x in once.repeated().collect()}
    crossed = {x.line_hash: x.now_repeated for x in R.crossed_lines(first, both).collect()}
    before, after = ({x[0] for x in s.repeated().collect()} for s in (first, both))
    assert crossed == {h: h in after for h in before ^ after}


def test_rebuild_holds_new_and_crossed_documents_only(spark):
    same = [(i, "s", f"notice\nown {chr(97 + i)}", "") for i in range(4)]
    other = [(100 + i, "t", "quiet line " + chr(97 + i), "") for i in range(3)]
    more = [(10, "s", "notice\nelse", "")]
    df = spark.createDataFrame(same + other + more, SCHEMA)
    before = R.LineCounts.empty(spark).merge(df.where("stored_id <> 10"))
    after = before.merge(df.where("stored_id = 10"))
    out = {x.stored_id: x.content for x in R.rebuild_after_delta(before, after, df).collect()}
    assert out == {**{i: f"own {chr(97 + i)}" for i in range(4)}, 10: "else"}


def test_without_lines_keeps_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, "s", "a\nb\na", "x", 9), (2, "s", None, "y", 9), (3, "s", "", "z", 9)], SCHEMA + ", _drop int")
    gone = spark.createDataFrame([(1, 1), (1, 3)], "stored_id long, line_no int")
    out = {x.stored_id: (x.content, x.removed_lines, x.extra) for x in R.without_lines(df, gone).collect()}
    assert out == {1: ("b", 2, "x"), 2: (None, 0, "y"), 3: ("", 0, "z")}


def test_empty_table_and_long_text(spark):
    assert found(spark, []) == set()
    rows = [(i, None, "\n".join(f"line {chr(97 + k % 26)}{k}" for k in range(30_000)), "") for i in range(5)]
    assert len(found(spark, rows)) == 150_000


def test_store_reads_old_documents_for_crossed_lines_only(spark, tmp_path):
    rows = [(i, "s", f"notice\nown {chr(97 + i)}", "") for i in range(4)] + [(100 + i, "t", "quiet line " + chr(97 + i), "") for i in range(30)] + [(None, "s", "notice", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    store = R.LineStore(spark, str(tmp_path))
    first = store.merge(df)
    assert store.found().count() == 0 and first.touched.count() == 34
    again = R.LineStore(spark, str(tmp_path))  # another process goes on where this one ended
    assert again.version == 1
    both = df.unionByName(spark.createDataFrame([(10, "s", "notice\nelse", ""), (3, "s", "seen before", "")], SCHEMA))
    delta = again.merge(both)
    assert {x.stored_id for x in delta.touched.collect()} == {0, 1, 2, 3, 10}
    assert [x.now_repeated for x in delta.crossed.collect()] == [True]
    assert {x.stored_id: x.content for x in again.rebuilt(df, delta).collect()} == {i: f"own {chr(97 + i)}" for i in range(4)}
    more = spark.createDataFrame([(1000 + i, "s", "other " + chr(97 + i % 26) * (1 + i // 26), "") for i in range(200)], SCHEMA)
    delta = again.merge(more)  # the site's total grows until the line is no longer repeated
    assert [x.now_repeated for x in delta.crossed.collect()] == [False]
    assert again.found().count() == 0 and delta.touched.count() == 205


def test_number_of_deltas_does_not_matter(spark):
    rows = [x for x in made(5, 150)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(x.stored_id, x.line_no) for x in R.repeated_line_occurrences(df, deltas=3).collect()} == plain(rows)


def test_null_ids_count_nowhere(spark, monkeypatch):
    rows = [(i if i else None, "s", "notice", "") for i in range(6)]
    assert len(found(spark, rows)) == 5
    monkeypatch.setattr(R, "BROADCAST_LINES", 0)
    assert len(found(spark, rows)) == 5
