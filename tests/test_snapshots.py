"""The snapshot comparison against a plain comparison of dictionaries, and its cases at the edges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loam.operators import snapshots as S

SCHEMA = "entry_id long, snapshot_no int, site string, file_key string, md5 string, fetch_date string, extra string"


def plain(rows):
    """Changes by dictionaries."""
    state = {}
    for entry_id, no, site, key, md5, at, _ in rows:
        if None in (no, site, key):
            continue
        h = (md5 or "").strip().lower() or None
        rank = ((at or "").replace("T", " "), entry_id)
        if (site, no, key) not in state or rank > state[site, no, key][0]:
            state[site, no, key] = (rank, h)
    out, sites = set(), {}
    for site, no, _ in state:
        sites.setdefault(site, set()).add(no)
    for site, nos in sites.items():
        for a, b in zip(sorted(nos), sorted(nos)[1:]):
            then = {k: v[1] for (s, n, k), v in state.items() if (s, n) == (site, a)}
            now = {k: v[1] for (s, n, k), v in state.items() if (s, n) == (site, b)}
            out |= {(b, k, "added") for k in now.keys() - then.keys()} | {(b, k, "removed") for k in then.keys() - now.keys()}
            out |= {(b, k, "changed") for k in now.keys() & then.keys() if now[k] and then[k] and now[k] != then[k]}
    return out


def changes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.snapshot_no, r.file_key, r.change_kind) for r in S.snapshot_changes(df).collect()}


def test_random_snapshots(spark):
    r = random.Random(3)
    rows, n = [], 0
    for site, files in (("a", 900), ("b", 30), ("c", 2)):
        for no in (1, 2, 4):
            for k in range(files):
                for _ in range(r.choice((0, 1, 1, 1, 1, 2))):
                    n += 1
                    md5 = r.choice(("aa", "aa", "aa", "AA ", "bb", None, "", f"{r.randint(0, 3)}f"))
                    rows.append((n, no, site, f"{site}/{k}", md5, f"2024-01-0{r.randint(1, 5)}{r.choice('T ')}10:00:0{r.randint(0, 9)}", "x"))
    assert changes(spark, rows) == plain(rows)


def test_edges(spark):
    rows = [
        (1, 1, "a", "a/x", "0AB", "2024-01-01", "e"),
        (2, 2, "a", "a/x", " ab\n", "2024-02-01", "e"),  # the same value, written otherwise
        (3, 2, "a", "a/y", None, "2024-02-01", "e"),
        (4, 3, "a", "a/y", "cc", "2024-03-01", "e"),  # unknown before: no change
        (5, 3, "a", "a/z", "dd", None, "e"),
        (5, 3, "a", "a/z", "dd", None, "e"),  # delivered twice
        (6, None, "a", "a/q", "dd", None, "e"),
        (7, 5, "b", "b/1", "dd", None, "e"),  # a first snapshot
    ]
    assert changes(spark, rows) == {(2, "a/y", "added"), (3, "a/x", "removed"), (3, "a/z", "added")}


def test_empty_table(spark):
    assert changes(spark, []) == set()


def test_only_differing_leaves_are_found(spark):
    rows = [(k, no, "a", f"a/{k}", "aa" if (k, no) != (77, 2) else "bb", "2024-01-01", "") for k in range(2000) for no in (1, 2)]
    state = S.snapshot_state(spark.createDataFrame(rows, SCHEMA))
    pairs = S.consecutive(state)
    digests = S.leaf_digests(state, pairs)
    assert S.differing_leaves(digests, pairs).count() == 1
    assert digests.where("snapshot_no = 1").agg(F.sum("rows")).first()[0] == 2000


@pytest.mark.parametrize(("text", "value"), [(" AB\t", "ab"), ("00ab", "ab"), ("0xAB", "ab"), ("", None), ("  ", None), (None, None), ("000", "0")])
def test_hex_value(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(S.hex_value(F.col("t"))).first()[0] == value
