"""Leaked items: altered and partial passages are found, shared sentences are not; seeds against a plain hash."""

from __future__ import annotations

import random

import numpy as np
import pytest

from loam.llm import leakage as L

R = random.Random(9)
WORDS = ["".join(R.choices("abcdefghiklmnoprstu", k=R.randint(3, 9))) for _ in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def noisy(text, seed):
    """About every fifteenth character wrong, missing or doubled."""
    r = random.Random(seed)
    return "".join(r.choice(("", "q", c + c)) if c.isalpha() and r.random() < 1 / 15 else c for c in text)


ITEMS = [(1, prose(1, 60)), (2, prose(2, 60)), (3, prose(3, 60)), (4, prose(1, 60)), (5, "".join(chr(0x4E00 + random.Random(k).randint(0, 3000)) for k in range(150))), (6, None), (7, "")]


def found(spark, docs, items=ITEMS):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame(items, "item_id long, text string")
    return {(x.doc_id, x.item_id) for x in L.leaked_items(d, e).collect()}


def test_whole_partial_and_altered(spark):
    one, two, han = ITEMS[0][1], ITEMS[1][1], ITEMS[4][1]
    docs = [
        (10, prose(50, 200) + "\n" + one + "\n" + prose(51, 200)),
        (11, "> **" + two.upper().replace(" ", "\n> ") + "**"),
        (12, prose(52, 90) + noisy(ITEMS[2][1], 4) + prose(53, 90)),
        (13, prose(54, 90) + two[: int(len(two) * 0.62)] + prose(55, 90)),
        (14, " ".join(han)),
        (15, han.translate({ord(c): c for c in han})[60:145] + prose(57, 50)),
    ]
    assert found(spark, docs) == {(10, 1), (10, 4), (11, 2), (12, 3), (13, 2), (14, 5), (15, 5)}


def test_no_leaks(spark):
    two = ITEMS[1][1]
    third = len(two) // 3
    docs = [(20, prose(60, 400)), (21, prose(61, 40) + two[:third] + prose(62, 40)), (22, None), (23, ""), (24, "abc"), (25, two[:third] + prose(63, 120) + two[third : 2 * third] + prose(64, 120) + two[2 * third :])]
    assert found(spark, docs) == set()


def test_repeated_rows_long_text_and_empty_tables(spark):
    doc = (30, prose(70, 60_000) + ITEMS[0][1])
    assert found(spark, [doc, doc]) == {(30, 1), (30, 4)}
    assert found(spark, []) == set()
    assert found(spark, [doc], []) == set()


def test_seeds_ignore_masked_positions():
    mask = L.MASKS[0]
    base = np.arange(97, 97 + len(mask), dtype=np.uint32)
    for k, bit in enumerate(mask):
        other = base.copy()
        other[k] = 7
        same = (L.seed_hashes(base, mask, 0) == L.seed_hashes(other, mask, 0)).all()
        assert same == (bit == "0")
    assert len(L.seed_hashes(base[:5], mask, 0)) == 0


@pytest.mark.parametrize(("a", "b"), [("ＡＢＣ１", "abc1"), ("Straße!", "STRAßE"), ("a-b c\r\n", "ABC"), ("ﬁn", "fn")])
def test_compared_characters(a, b):
    assert (L.compared([a])[0] == L.compared([b])[0]).all()


def test_blocks_of_items_give_the_same(spark):
    r = random.Random(3)
    items = [(i, "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=2000))) for i in range(600)] + ITEMS
    docs = [(100 + k, prose(80 + k, 50) + items[k * 7][1][300:1500] + prose(90 + k, 50)) for k in range(80)] + [(900, ITEMS[0][1])]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(x) for x in L.leaked_items(d, e, block_chars=10_000_000).collect()}
    assert {tuple(x) for x in L.leaked_items(d, e, block_chars=200_000).collect()} == whole
    assert {(x[0], x[1]) for x in whole} == {(100 + k, k * 7) for k in range(80)} | {(900, 1), (900, 4)}


def test_passage_across_any_band_of_diagonals(spark):
    """Characters are put in all along, so that the diagonal moves by far more than one window."""
    item = prose(7, 120)
    moved = "".join(c + ("z" if i % 25 == 0 else "") for i, c in enumerate(item))
    assert found(spark, [(1, prose(71, 500) + moved + prose(72, 500))], [(1, item)]) == {(1, 1)}


def test_hits_against_a_plain_search():
    texts = [ITEMS[0][1], ITEMS[1][1]]
    seeds = L.block_seeds(tuple(texts))
    chars, offsets = L.compared([prose(5, 30), texts[1][20:120], prose(6, 30) + texts[0][:80]])
    doc, at, item = L.hits_of(chars, offsets, seeds)
    plain = set()
    for k, mask in enumerate(L.MASKS):
        own = {int(h): i for i, t in enumerate(texts) for h in L.seed_hashes(L.compared([t])[0], mask, k)}
        for d in range(3):
            part = chars[offsets[d] : offsets[d + 1]]
            plain |= {(d, int(offsets[d]) + p, own[int(h)]) for p, h in enumerate(L.seed_hashes(part, mask, k)) if int(h) in own}
    assert set(zip(doc.tolist(), at.tolist(), item.tolist())) == plain


def test_passage_in_self_repeating_text_is_joined_across_a_wrong_character():
    """Far more open chains than the one that counts, which is the oldest."""
    item = np.frombuffer(b"ab" * 100, dtype=np.uint8)
    doc = item.copy()
    doc[100] = ord("x")
    assert L.passage_part(item, doc) == 1.0
