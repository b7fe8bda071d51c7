"""Evaluation texts inside a training corpus, by spaced seeds.

Texts are compared as rows of letters and digits, without case, spacing, punctuation, markup and character width. A
spaced seed is a mask over a window of these characters: the hash of a window ignores the masked-out positions, so that
a wrong character there does no harm, and several masks leave few errors that harm all of them. The hashes of a block of
test items are joined with those of the documents in the scan of the documents; around each joined position the texts are
aligned at once and the length of the running passage is measured. No text is shuffled. Test items of any size are
searched in blocks, a scan each.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.textbytes import chunks, code_points, column
from loam.sources.scratch import spread

#: The spaced seeds: 1 is a position that counts. Ten of fourteen positions; no two masks ignore the same ones.
MASKS = ("11101100101111", "11011110011011", "10111011110101")
#: The part of an item that makes a leak when it stands in a document as one running passage.
MIN_PART = 0.5
#: A passage ends where more than so many characters in a row don't match.
MAX_GAP = 12
#: Characters that must agree in a row to belong to a passage, and the part of a passage that such runs must cover.
MATCH_RUN = 4
MIN_EQUAL = 0.62
#: Characters of test items that are searched in one scan: their texts, and about 60 bytes a character as hashes, are in
#: every worker.
BLOCK_CHARS = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _table() -> np.ndarray:
    """Code point to compared character: 0 for what is left out. Made once a process, by Unicode's own rules."""
    table = np.arange(0x110000, dtype=np.uint32)
    for cp in [*range(0x3000), *range(0xF900, 0x10000), *range(0x2F800, 0x2FA20), *range(0x1D400, 0x1D800)]:
        form = [c for c in unicodedata.normalize("NFKC", chr(cp)).lower() if c.isalnum()]
        table[cp] = ord(form[0]) if form else 0
    for cp in [*range(0x3000, 0x3400), *range(0xE000, 0xF900), *range(0x1F000, 0x20000), *range(0xE0000, 0xE1000)]:
        form = [c for c in unicodedata.normalize("NFKC", chr(cp)).lower() if c.isalnum()]
        table[cp] = ord(form[0]) if form else 0
    return table


def compared(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The compared characters of all texts in a row, and each text's offset (one more than texts)."""
    chars, offsets = code_points(texts)
    chars = _table()[chars]
    kept = chars != 0
    before = np.concatenate([[0], np.cumsum(kept)])
    return chars[kept], before[offsets]


def seed_hashes(chars: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of the window at each position (as many as whole windows fit)."""
    n = len(chars) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, number + 1, dtype=np.uint64)
    wide = chars.astype(np.uint64)
    with np.errstate(over="ignore"):
        for i, bit in enumerate(mask):
            if bit == "1":
                out *= _MIX
                out += wide[i : i + n]
        out ^= out >> np.uint64(29)
        out *= _MIX
    return out


class Seeds(NamedTuple):
    """A block of test items: their compared characters, and all their hashes in order with item (index) and position."""

    chars: list[np.ndarray]
    hash: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    #: Which top bits of a hash occur: about eight places for each hash rule out most windows of other texts.
    bits: np.ndarray
    shift: np.uint64


def block_seeds(texts: tuple[str, ...]) -> Seeds:
    chars = [compared([text])[0] for text in texts]
    hashes, item, pos = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, own in enumerate(chars):
        for k, mask in enumerate(MASKS):
            hashes.append(seed_hashes(own, mask, k))
            item.append(np.full(len(hashes[-1]), i))
            pos.append(np.arange(len(hashes[-1])))
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    width = max(16, int(8 * len(h)).bit_length())
    bits, shift = np.zeros(1 << width, dtype=bool), np.uint64(64 - width)
    bits[h >> shift] = True
    return Seeds(chars, h[order], np.concatenate(item)[order], np.concatenate(pos)[order], bits, shift)


def hits_of(chars: np.ndarray, offsets: np.ndarray, seeds: Seeds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows of the texts have the hash of an item's window: text (index), position in all characters, item."""
    out = []
    for k, mask in enumerate(MASKS):
        h = seed_hashes(chars, mask, k)
        at = np.flatnonzero(seeds.bits[h >> seeds.shift])
        left = np.searchsorted(seeds.hash, h[at], "left")
        n = np.searchsorted(seeds.hash, h[at], "right") - left
        at, left, n = at[n > 0], left[n > 0], n[n > 0]
        doc = np.searchsorted(offsets, at, side="right") - 1
        inside = at + len(mask) <= offsets[doc + 1]
        at, left, n, doc = at[inside], left[inside], n[inside], doc[inside]
        row = np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else left
        out.append((np.repeat(doc, n), np.repeat(at, n), seeds.item[row.astype(np.int64)]))
    doc, at, item = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((at, item, doc))
    return doc[order], at[order], item[order]


def leaks_of(texts: list[str], seeds: Seeds, min_part: float) -> Iterator[tuple[int, int, float]]:
    """(text, item, part) for each text that holds at least ``min_part`` of an item of the block.

    Hits of a text and an item that lie farther apart than twice the item are aligned by themselves.
    """
    chars, offsets = compared(texts)
    doc, at, item = hits_of(chars, offsets, seeds)
    if not len(doc):
        return
    sizes = np.array([len(c) for c in seeds.chars])
    new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(at) > 2 * sizes[item[1:]])])
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:], [len(doc)]]) - 1
    best: dict[tuple[int, int], float] = defaultdict(float)
    for a, b in zip(starts.tolist(), ends.tolist()):
        d, i = int(doc[a]), int(item[a])
        reach = 2 * len(seeds.chars[i])
        low, high = max(int(offsets[d]), int(at[a]) - reach), min(int(offsets[d + 1]), int(at[b]) + reach)
        best[d, i] = max(best[d, i], passage_part(seeds.chars[i], chars[low:high], min_part))
    yield from ((d, i, part) for (d, i), part in best.items() if part >= min_part)


def passage_part(item: np.ndarray, doc: np.ndarray, min_part: float = 0.0) -> float:
    """The longest running passage of ``item`` in ``doc`` as a part of the item.

    Runs of MATCH_RUN equal characters on nearby diagonals are chained as long as fewer than MAX_GAP characters of either
    text lie between them; the passage reaches from the first run's start to the last one's end. 0 where the characters that
    occur in such runs at all are too few for a passage of ``min_part``.
    """
    k = MATCH_RUN
    if len(item) < k or len(doc) < k:
        return 0.0

    def grams(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x) - k + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out = out * _MIX + x[j : j + len(out)].astype(np.uint64)
        return out

    a, b = grams(item), grams(doc)
    order = np.argsort(b, kind="stable")
    left, right = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    count = right - left
    covered = np.convolve(count > 0, np.ones(k, dtype=int)) > 0
    if covered.sum() < MIN_EQUAL * min_part * len(item):
        return 0.0
    i = np.repeat(np.arange(len(a)), count)
    j = order[np.repeat(left - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
    if not len(i):
        return 0.0
    # runs: hits that follow one another on one diagonal
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    new = np.concatenate([[True], (np.diff(j - i) != 0) | (np.diff(i) != 1)])
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:], [len(i)]]) - 1
    runs = sorted(zip(i[starts].tolist(), j[starts].tolist(), (i[ends] + k).tolist(), (j[ends] + k).tolist()))
    best = 0
    chains: dict[int, list[tuple]] = {}  # open chains by the diagonal of their end: item start, item end, doc end, equal characters, number
    for n, (i0, j0, i1, j1) in enumerate(runs):
        choice = None
        for diagonal in range(j0 - i0 - 6, j0 - i0 + 7):
            alive = chains.get(diagonal)
            if not alive:
                continue
            if any(i0 - c[1] > MAX_GAP for c in alive):
                chains[diagonal] = alive = [c for c in alive if i0 - c[1] <= MAX_GAP]
            for c in alive:
                # of equal ones the oldest
                if -k <= i0 - c[1] and -k <= j0 - c[2] <= MAX_GAP and (choice is None or (c[3], -c[4]) > (choice[3], -choice[4])):
                    choice = c
        equal = i1 - i0
        if choice:
            equal = choice[3] + equal - max(0, choice[1] - i0, choice[2] - j0)
            chain = (choice[0], max(i1, choice[1]), j1, equal, n)
        else:
            chain = (i0, i1, j1, equal, n)
        chains.setdefault(chain[2] - chain[1], []).append(chain)
        if chain[3] >= MIN_EQUAL * (chain[1] - chain[0]):
            best = max(best, chain[1] - chain[0])
    return best / len(item)


def leaked_items(docs: DataFrame, items: DataFrame, min_part: float = MIN_PART, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents (doc_id, text) that hold at least ``min_part`` of an item's text (item_id, text) as one running passage.

    Output: doc_id, item_id, part. Each of several items with one text is found. Null and empty texts on either side
    give nothing, nor do items shorter than a seed. Items of more than ``block_chars`` characters in all are divided into
    blocks by hash, and the documents are scanned once for each block; a block's texts are in every worker. Of a repeated
    or differing row of a doc_id or item_id the greatest part counts. Other columns are ignored.
    """
    items = items.select("item_id", "text").where("item_id is not null and text is not null and text <> ''").distinct()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and doc_id is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = None
    for k in range(blocks):
        part = _leaks_in(docs, items.where(block == k), min_part)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("part").alias("part"))


def _leaks_in(docs: DataFrame, block: DataFrame, min_part: float) -> DataFrame:
    """The leaks of one block of items: doc_id, item_id, part."""
    ids: dict[str, list[int]] = defaultdict(list)
    for row in block.collect():
        ids[row.text].append(row.item_id)
    texts = tuple(sorted(ids))
    shared = docs.sparkSession.sparkContext.broadcast((texts, [ids[t] for t in texts]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, items = shared.value
        seeds = block_seeds(own)
        for batch in batches:
            doc_ids = column(batch, "doc_id")
            out = [
                (doc_ids[first + d], item, part)
                for first, run in chunks(column(batch, "text"))
                for d, i, part in leaks_of(run, seeds, min_part)
                for item in items[i]
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "item_id", "part"]
            )

    return spread(docs).mapInArrow(rows, "doc_id long, item_id long, part double")
