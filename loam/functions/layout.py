"""Laid-out lines (text, size, y0, x0) of a document as Markdown."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines whose tops differ by so much at most stand in one row; a row of so many items is a table's.
ROW_TOLERANCE, TABLE_ITEMS = 4.0, 3
INDENT, GAP = 15.0, 25.0
#: How numbered lines begin.
_LISTED = re.compile(r"第[一二三四五六七八九十百千万]+[章节条]|[0-9]+[．.、]|[一二三四五六七八九十]、|（[一二三四五六七八九十]+）|\([0-9]+\)")


def rows_of(lines: list[dict]) -> list[dict]:
    """Rows from top to bottom, their items from left to right. A row is measured from its first line."""
    rows: list[list[dict]] = []
    top = None
    for line in sorted(lines, key=lambda x: x["y0"]):
        if top is None or abs(line["y0"] - top) > ROW_TOLERANCE:
            rows.append([])
            top = line["y0"]
        rows[-1].append(line)
    out = []
    for row in rows:
        row.sort(key=lambda x: x["x0"])
        out.append({"items": [x["text"].replace("|", "｜") for x in row], "size": max(x["size"] for x in row), "x0": row[0]["x0"], "y0": min(x["y0"] for x in row)})
    return out


def _mode(values: list[float], default: float) -> float:
    """The most frequent value, of equals the first seen."""
    return Counter(values).most_common(1)[0][0] if values else default


def layout_markdown(lines: list[dict]) -> str:
    """Headings by size over the usual one, tables from rows of several items, paragraphs by indent, gap and numbering."""
    lines = [x for x in lines or [] if x["text"].strip()]
    if not lines:
        return ""
    rows = rows_of(lines)
    usual = _mode([round(x["size"], 1) for x in lines], 10.0)
    margin = _mode([r["x0"] for r in rows if r["size"] <= usual + 1], 50.0)
    out: list[str] = []
    paragraph: list[str] = []
    width = 0  # of the open table

    def close() -> None:
        if paragraph:
            out.append("　　" + "".join(paragraph) + "\n\n")
            paragraph.clear()

    for i, row in enumerate(rows):
        if len(row["items"]) >= TABLE_ITEMS:
            close()
            if not width:
                width = len(row["items"])
                out.append("| " + " | ".join(row["items"]) + " |\n|" + "|".join(["---"] * width) + "|\n")
            else:
                out.append("| " + " | ".join((row["items"] + [""] * width)[:width]) + " |\n")
            continue
        if width:
            width = 0
            out.append("\n")
        text, over = "　　".join(row["items"]), row["size"] - usual
        level = 1 if over > 4 else 2 if over > 1.5 else 3 if over > 0.1 else 0
        if level:
            close()
            out.append("#" * level + f" {text}\n\n")
            continue
        gap = row["y0"] - rows[i - 1]["y0"] if i else 0
        if row["x0"] > margin + INDENT or gap > GAP or _LISTED.match(text):
            close()
        paragraph.append(text)
    close()
    return "".join(out).strip() + "\n"


@F.pandas_udf(T.StringType())
def layout_to_markdown(lines: pd.Series) -> pd.Series:
    """As ``layout_markdown`` over a column of array<struct<text, size, y0, x0>>; null gives an empty text."""
    return lines.map(lambda x: layout_markdown(list(x)) if x is not None else "")


def best_window(text: str, words: list[str]) -> tuple[int, int]:
    """The stretch of ``text`` (start, end) in which most of the words stand, longer ones counting more.

    A window is as long as four times all words, 1500 characters at least. It ends with the last word that is new in it;
    of equally good ones the shortest is taken. No word found: (-1, -1).
    """
    words = [w.lower() for w in dict.fromkeys(words) if w]
    low = text.lower()
    at = sorted((m.start(), k) for k, w in enumerate(words) for m in re.finditer(f"(?={re.escape(w)})", low))
    span, best = max(1500, 4 * sum(map(len, words))), (0, 0, -1, -1)
    for i, (start, _) in enumerate(at):
        seen, score, end = set(), 0, start
        for pos, k in at[i:]:
            if pos > start + span or len(seen) == len(words):
                break
            if k not in seen:
                seen.add(k)
                score += len(words[k])
                end = max(end, pos + len(words[k]))
        best = max(best, (score, start - end, start, end), key=lambda b: b[:2]) if best[0] else (score, start - end, start, end)
    return best[2:]


@F.pandas_udf(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()))
def highlight_window(text: pd.Series, words: pd.Series) -> pd.DataFrame:
    """As ``best_window`` over columns."""
    return pd.DataFrame([best_window(t or "", list(w) if w is not None else []) for t, w in zip(text, words)], columns=["start", "end"])
