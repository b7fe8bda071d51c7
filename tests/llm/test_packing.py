"""Packing: every text once, containers within capacity, little room left; ranks without one task a length."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from loam.llm import packing as P


def packed(spark, lengths, capacity):
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long")
    return P.pack(df, capacity).collect()


def check(rows, lengths, capacity):
    fill, per = Counter(), defaultdict(list)
    for x in rows:
        fill[x.container_id] += x.length
        per[x.doc_id].append((x.piece_no, x.token_start, x.length))
    assert set(per) == set(range(len(lengths)))
    for d, n in enumerate(lengths):
        pieces = sorted(per[d])
        assert sum(p[2] for p in pieces) == n
        assert [p[1] for p in pieces] == [k * capacity for k in range(max(1, math.ceil(n / capacity)))]
    assert max(fill.values()) <= capacity
    return fill


def test_random_lengths(spark):
    r = random.Random(2)
    lengths = [r.choice((r.randint(0, 400), r.randint(1, 30), 57, 57)) for _ in range(3000)]
    fill = check(packed(spark, lengths, 128), lengths, 128)
    used = [c for c, n in fill.items() if n]
    assert sum(lengths) / (128 * len(used)) > 0.96
    assert sorted(used) == list(range(len(used)))


def test_hot_length_and_rank_parts(spark):
    lengths = [40] * 900 + [24] * 100
    fill = check(packed(spark, lengths, 64), lengths, 64)
    assert len(fill) == 900  # a pair of 40 doesn't fit; each 24 completes one


def test_edges(spark):
    assert packed(spark, [], 10) == []
    assert [x.container_id for x in packed(spark, [0, 0], 10)] == [0, 0]
    check(packed(spark, [10, 11, 100, 1], 10), [10, 11, 100, 1], 10)
    with pytest.raises(ValueError):
        packed(spark, [1], 0)


@pytest.mark.parametrize("seed", range(5))
def test_patterns_use_every_piece(seed):
    r = random.Random(seed)
    histogram = {n: r.randint(1, 50) for n in r.sample(range(1, 101), 40)}
    used = Counter()
    for pattern, count in P.packing_patterns(histogram, 100):
        assert sum(n * times for n, times in pattern) <= 100
        for n, times in pattern:
            used[n] += times * count
    assert used == histogram


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "doc_id long, text string")
    got = {x.doc_id: x.n_tokens for x in P.token_counts(df).collect()}
    assert got[2] == got[3] == 0 and got[1] >= 2 and got[4] > 1
