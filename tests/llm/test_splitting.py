"""Pieces of oversized texts: limits, overlap and round trip; the cuts against a plain greedy walk."""

from __future__ import annotations

import random

import pytest

from loam.llm import splitting as S

MOST, OVER = 120, 20


def greedy(text, most, over):
    """The cuts, one after another."""
    marks = [(p, k) for p, k in S.boundaries(text, most) if p > over]
    at, cuts = over, []
    while at < len(text):
        start = at - over
        if len(text) <= start + most:
            at = len(text)
        else:
            at = max((k, p) for p, k in marks if start + most // 2 <= p <= start + most)[1]
        cuts.append(at)
    return cuts


def texts():
    r = random.Random(5)
    out = []
    for shape in ("words", "lines", "han", "solid", "emoji", "mixed"):
        for _ in range(4):
            n = r.randint(100, 900)
            out.append({
                "words": lambda: " ".join("".join(r.choices("abcdef", k=r.randint(1, 12))) + r.choice(("", "", ".", ",")) for _ in range(n // 6)),
                "lines": lambda: "\n".join("x" * r.randint(0, 60) for _ in range(n // 20)),
                "han": lambda: "".join(r.choice("天地玄黄宇宙洪荒。，！\n") for _ in range(n)),
                "solid": lambda: "z" * n,
                "emoji": lambda: "👍🏽👩‍👩‍👧" * (n // 8),
                "mixed": lambda: "é́ " * (n // 6) + "\r\n\r\n" + "字" * (n // 2),
            }[shape]())
    return out


def test_pieces(spark):
    all_texts = texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(all_texts)] + [(0, all_texts[0], 2)], "id long, body string, rec int")
    got: dict[int, list] = {}
    for x in S.split_oversized(df, "id", "body", MOST, OVER).collect():
        got.setdefault(x.rec, []).append((x.piece_no, x.piece_start, x.piece_end, x.piece))
    assert set(got) == {i for i, t in enumerate(all_texts) if len(t) > MOST}
    for i, pieces in got.items():
        pieces.sort()
        text = all_texts[i]
        assert [p[0] for p in pieces] == list(range(1, len(pieces) + 1))
        assert [p[2] for p in pieces] == greedy(text, MOST, OVER)
        assert all(len(p[3]) <= MOST and p[3] == text[p[1] : p[2]] for p in pieces)
        assert all(b[1] == a[2] - OVER for a, b in zip(pieces, pieces[1:]))
        assert pieces[0][3] + "".join(p[3][OVER:] for p in pieces[1:]) == text


def test_natural_ends_come_first():
    text = "a" * 70 + ".\n\n" + "b" * 40 + ". " + "c" * 60
    assert greedy(text, MOST, OVER)[0] == 73  # the paragraph's end, not the sentence's


def test_characters_are_not_parted():
    text = "👩‍👩‍👧" * 100
    for at, kind in S.boundaries(text, 40):
        assert kind == S.END or not S.splits_character(text, at)


def test_nulls_empty_and_limit(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * MOST), (None, "y" * 500), (4, "x" * (MOST + 1))], "id long, body string")
    assert {x.rec for x in S.split_oversized(df, "id", "body", MOST, OVER).collect()} == {4}
    assert S.split_oversized(df.where("false"), "id", "body", MOST, OVER).count() == 0


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "no end " * 60_000)], "id long, body string")
    assert S.piece_bounds(S.oversized(df, "id", "body", 4000), 4000, 300).agg({"piece_end": "max"}).first()[0] == 420_000


def test_overlap_must_leave_room(spark):
    df = spark.createDataFrame([(1, "x")], "rec long, text string")
    with pytest.raises(ValueError):
        S.piece_bounds(df, 100, 50)
