"""Cutting oversized texts at natural boundaries, all cuts of all texts in parallel.

Every boundary of a text is joined to its farthest legal successor: the end of the piece that would start at this
boundary less the overlap. The greedy cuts are the boundaries on the path from the text's start. They are found by
pointer doubling: the set reached from the start is joined with the successor table, which is squared after each step, so
a text of n pieces takes log2(n) joins.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.textbytes import column
from loam.sources.scratch import stored

#: Kinds of boundary, the more natural the higher; GRID is none at all, a place where a cut does no harm.
END, PARAGRAPH, LINE, SENTENCE, CLAUSE, SPACE, GRID = 6, 5, 4, 3, 2, 1, 0
_STRONG = re.compile(r"(?P<p>\n[^\S\n]*(?:\n\s*)+)|(?P<l>\n)|(?P<s>[。！？…]+[”’」』）)\"]*|[.!?]+[”’»)\"]*(?=\s))")
_WEAK = re.compile(r"(?P<c>[，、；：]|[,;:](?=\s))|(?P<w>\s+)")
_JOINERS = "‍"


def splits_character(text: str, at: int) -> bool:
    """Whether a cut before ``text[at]`` would part what a reader sees as one character."""
    if not 0 < at < len(text):
        return False
    before, after = text[at - 1], text[at]
    return (
        after in _JOINERS
        or before in _JOINERS
        or "︀" <= after <= "️"
        or "\U0001f3fb" <= after <= "\U0001f3ff"
        or (before == "\r" and after == "\n")
        or unicodedata.category(after) in ("Mn", "Me", "Mc")
    )


def boundaries(text: str, max_size: int) -> list[tuple[int, int]]:
    """(position, kind) of every place where ``text`` may be cut, in code points.

    All paragraph, line and sentence ends; where these are farther apart than an eighth of ``max_size``, clause ends and
    white space; where there is nothing either, grid positions, so that every half window has a boundary.
    """
    gap = max(1, max_size // 8)
    found = {len(text): END}
    for m in _STRONG.finditer(text):
        kind = PARAGRAPH if m["p"] else LINE if m["l"] else SENTENCE
        found[m.end()] = max(kind, found.get(m.end(), 0))
    places = sorted({0, *found})
    for a, b in zip(places, places[1:]):
        if b - a <= gap:
            continue
        inner = {m.end(): CLAUSE if m["c"] else SPACE for m in _WEAK.finditer(text, a, b) if a < m.end() < b}
        found |= {k: v for k, v in inner.items() if k not in found}
        stops = [a, *sorted(inner), b]
        for x, y in zip(stops, stops[1:]):
            for at in range(x + gap, y, gap):
                back = at
                while back > at - gap + 1 and splits_character(text, back):
                    back -= 1
                # a run of signs that make one character and fill a whole grid step is cut all the same
                place = at if splits_character(text, back) else back
                found.setdefault(place, GRID)
    return sorted(found.items())


def boundary_table(records: DataFrame, max_size: int, overlap: int) -> DataFrame:
    """Boundaries of each record (rec, text): rec, pos, kind, size. The start is the row whose kind is -1; it stands at
    ``overlap``, as the first piece begins at 0 and every other one ``overlap`` before its boundary."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)] for _ in range(4)]
            for rec, text in zip(column(batch, "rec"), column(batch, "text")):
                at = np.array([(overlap, -1), *((p, k) for p, k in boundaries(text, max_size) if p > overlap)])
                for part, values in zip(parts, (np.full(len(at), rec), at[:, 0], at[:, 1], np.full(len(at), len(text)))):
                    part.append(values)
            arrays = [pa.array(np.concatenate(part).astype(kind)) for part, kind in zip(parts, (np.int64, np.int32, np.int32, np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["rec", "pos", "kind", "size"])

    return records.mapInArrow(rows, "rec long, pos int, kind int, size int")


def successors(table: DataFrame, max_size: int, overlap: int) -> DataFrame:
    """Each boundary with its farthest legal successor: rec, pos, nxt (null at the text's end).

    Legal: the piece keeps to ``max_size`` and fills at least half of it. Among these the most natural kind goes first,
    then the farthest. If the rest of the text fits, its end is the successor.
    """
    reach = Window.partitionBy("rec").orderBy("pos").rangeBetween(max_size // 2 - overlap, max_size - overlap)
    best = F.max(F.struct("kind", "pos")).over(reach)["pos"]
    rest_fits = F.col("size") <= F.col("pos") - overlap + max_size
    nxt = F.when(F.col("pos") >= F.col("size"), None).when(rest_fits, F.col("size")).otherwise(best)
    return table.select("rec", "pos", nxt.cast("int").alias("nxt"))


def greedy_cuts(table: DataFrame, max_size: int, overlap: int) -> DataFrame:
    """Where the pieces of each record end: rec, pos."""
    table = stored(table, "split-boundaries")
    longest = table.agg(F.max("size")).first()[0]
    jump = stored(successors(table, max_size, overlap).where("nxt is not null"), "split-successors")
    reached = table.where("kind = -1").select("rec", "pos")
    # a piece advances by half its size less the overlap at least
    most = math.ceil((longest or 1) / max(1, max_size // 2 - overlap)) + 1
    steps = math.ceil(math.log2(most)) + 1
    for step in range(steps):
        ahead = reached.join(jump, ["rec", "pos"]).select("rec", F.col("nxt").alias("pos"))
        reached = stored(reached.unionByName(ahead), "split-reached")
        if step < steps - 1:
            further = jump.select("rec", F.col("pos").alias("nxt"), F.col("nxt").alias("then"))
            jump = stored(jump.join(further, ["rec", "nxt"]).select("rec", "pos", F.col("then").alias("nxt")), "split-jumps")
    return reached.where(F.col("pos") != overlap).distinct()


def oversized(df: DataFrame, id_column: str, text_column: str, max_size: int) -> DataFrame:
    """Records of more than ``max_size`` code points, one row an id: rec, text. Null texts and ids are none.

    Of differing rows of one id the one with the greatest text holds.
    """
    return (
        df.select(F.col(id_column).cast("long").alias("rec"), F.col(text_column).alias("text"))
        .where((F.length("text") > max_size) & F.col("rec").isNotNull())
        .groupBy("rec")
        .agg(F.max("text").alias("text"))
    )


def piece_bounds(records: DataFrame, max_size: int, overlap: int) -> DataFrame:
    """Pieces of oversized records (rec, text): rec, piece_no (from 1), piece_start, piece_end, counted in code points.

    ``overlap`` must be under half of ``max_size``. Each piece but the first starts ``overlap`` before the end of the one
    before it.
    """
    if not 0 <= overlap < max_size // 2:
        raise ValueError("overlap must be at least 0 and under half of max_size")
    cuts = greedy_cuts(boundary_table(records, max_size, overlap), max_size, overlap)
    by_record = Window.partitionBy("rec").orderBy("pos")
    return cuts.select(
        "rec",
        F.row_number().over(by_record).alias("piece_no"),
        F.coalesce(F.lag("pos").over(by_record) - overlap, F.lit(0)).alias("piece_start"),
        F.col("pos").alias("piece_end"),
    )


def split_oversized(df: DataFrame, id_column: str, text_column: str, max_size: int, overlap: int) -> DataFrame:
    """The pieces of every text of more than ``max_size`` code points: rec, piece_no, piece_start, piece_end, piece.

    Pieces keep to ``max_size``, end at natural boundaries where the second half of a window has one, and overlap by
    exactly ``overlap``; texts within the limit, null and empty ones give no pieces. Other columns are ignored.
    """
    records = stored(oversized(df, id_column, text_column, max_size), "split-records")
    bounds = F.struct("piece_no", "piece_start", "piece_end")
    each = piece_bounds(records, max_size, overlap).groupBy("rec").agg(F.array_sort(F.collect_list(bounds)).alias("pieces"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(rec, p["piece_no"], p["piece_start"], p["piece_end"], text[p["piece_start"] : p["piece_end"]]) for rec, text, pieces in zip(*(column(batch, c) for c in ("rec", "text", "pieces"))) for p in pieces]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["rec", "piece_no", "piece_start", "piece_end", "piece"])

    return records.join(each, "rec").select("rec", "text", "pieces").mapInArrow(rows, "rec long, piece_no int, piece_start int, piece_end int, piece string")
