"""The main body of pages whose text mixes it with menus, notices, lists of other pages and footers: tree scoring.

Page text holds no tags, so the tree is read from the lines: a page has sections (opened by its title and by headings
that stand over text), a section has blocks (running text, lists, runs of short lines), a block has lines. A paragraph
gives points for its length and its commas, discounted by the part of it that is link text; they pass in full to its
block, by half to its section and by a third to the page. The section with the most points is the container. Of its
blocks, and of those of its sibling sections, the ones with points enough against the best block are kept; all else is
furniture. A page is judged by itself, in one pass, so that nothing is shuffled and nothing depends on the corpus' size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.textbytes import column
from loam.sources.scratch import spread

BLANK, TABLE, HEADING, ITEM, INTRO, STEP, PROSE, SHORT = range(8)
#: Points of a paragraph: so much for every 100 columns, and for a comma.
PER_100, PER_COMMA = 1.0, 0.5
#: The part of a paragraph's points that its section and its page receive.
TO_SECTION, TO_PAGE = 1 / 2, 1 / 3
#: A page with fewer points has no body.
MIN_POINTS = 0.13
#: A block stays from this part of the best block's points on: in the container, and in its sibling sections.
INSIDE, BESIDE = 0.06, 0.35
#: Blocks with more link text than this part are lists of links.
MAX_LINKS = 0.5

_WIDE = re.compile("[⺀-鿿가-힯＀-｠]")
_LINK = re.compile(r"!?\[([^\]]*)\]\([^)]*\)")
_BULLET = re.compile(r"^(?:[-*+•·▪◦]|\d{1,3}[.)、]|[a-zA-Z][.)])\s+")
_TABLE = re.compile(r"^\|.*\|$")
#: A short label before a colon; one that holds a number.
_LABEL = re.compile(r"^[^\s:：][^:：]{0,11}[:：]\s*\S")
_NUMBERED = re.compile(r"^[^\s\d:：][^:：\d]{0,10}\d{1,3}[^:：\d]{0,4}[:：]\s*\S")
_SENTENCE_END = re.compile(r"[。！？.!?…][”’」』）)\"»]*$")
#: What parts choices and links in a row: bars, brackets, dots, arrows, runs of white space.
_PARTS = re.compile(r"\s*(?:[|·•»>]|\]\s*\[|\s{2,}|　)\s*|\s+/\s+")
_COMMAS = re.compile("[,，、；;]")
_EDGES = "　\xa0﻿"
_DAY = re.compile(r"\d{1,4}\s*[-/.年月]\s*\d{1,2}|\d{1,2}(?:er|st|nd|rd|th)?\.?\s+[^\W\d]{3,9}\s+\d{4}|(?:^|[:：]\s*)(?:\d{1,2}(?:er|st|nd|rd|th)?\.?\s+[^\W\d]{3,9}\b|[^\W\d]{3,9}\s+\d{1,2}\b)")


def weight(text: str) -> int:
    """Length in columns: characters of wide scripts say about as much as two others."""
    return len(text) + len(_WIDE.findall(text))


def bare(line: str) -> str:
    """A line without indentation, heading marks, bullet and link targets."""
    text = line.strip().strip(_EDGES)
    text = _BULLET.sub("", re.sub(r"^[#>]+\s*", "", text))
    return _LINK.sub(r"\1", text).strip()


def link_density(text: str) -> float:
    """The part of a line's visible text that is link text."""
    if "](" not in text:
        return 0.0
    links = sum(len(m) for m in _LINK.findall(text))
    return links / max(1, len(_LINK.sub(r"\1", text)))


def kind_of(line: str) -> int:
    """What a line is by its own form alone."""
    text = line.strip().strip(_EDGES)
    if not text:
        return BLANK
    if text[0] == "|" and len(text) > 1 and _TABLE.match(text):
        return TABLE
    if text[0] == "#" and text.lstrip("#")[:1] == " ":
        return HEADING
    if _BULLET.match(text):
        return ITEM
    visible = _LINK.sub(r"\1", text) if "](" in text else text
    wide = weight(visible)
    if text[-1] in ":：" and wide <= 80:
        return INTRO
    if wide <= 80 and _NUMBERED.match(text):
        return STEP
    parts = sum(map(bool, _PARTS.split(visible)))
    choices = "|" in visible or parts >= 3 and wide / parts < 40
    if not choices and _SENTENCE_END.search(visible) and (wide >= 16 or _LABEL.match(text)) and link_density(text) < MAX_LINKS:
        return PROSE
    if wide >= 160 and len(_COMMAS.findall(visible)) >= 2 and link_density(text) < MAX_LINKS:
        return PROSE
    return SHORT


def points(line: str) -> float:
    """What a paragraph gives to its ancestors: for length and commas, discounted by its link density."""
    text = bare(line)
    return (PER_100 * weight(text) / 100 + PER_COMMA * len(_COMMAS.findall(text))) * (1 - link_density(line))


@dataclass
class Block:
    """Running text with its points, or a list or run of short lines, which has none."""

    text: bool
    lines: list[int] = field(default_factory=list)
    points: float = 0.0
    #: Short lines that stand between the lines of a text; they belong to no paragraph.
    between: list[int] = field(default_factory=list)


@dataclass
class Section:
    """What stands under one heading (level 0: under none). ``top``: its heading and the date and reference below it."""

    level: int
    top: list[int] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)

    def points(self) -> float:
        return TO_SECTION * sum(b.points for b in self.blocks)


def title_line(lines: list[str], kinds: list[int], title: str | None) -> int | None:
    """Where the page's title stands in its text: the line equal to it that is neither item nor link."""
    wanted = re.sub(r"\s+", "", title or "").lower()
    if not wanted:
        return None
    equal = (i for i, k in enumerate(kinds) if k not in (BLANK, ITEM) and "](" not in lines[i] and re.sub(r"\s+", "", bare(lines[i])).lower() == wanted)
    return next(equal, None)


def dated(line: str) -> bool:
    """Whether a short line states a day or a reference: it holds a date or five digits and is no row of choices."""
    text = bare(line)
    return weight(text) <= 80 and len(_PARTS.split(text)) <= 2 and bool(sum(map(str.isdigit, text)) >= 5 or _DAY.search(text))


def tree(lines: list[str], title: str | None) -> list[Section]:
    """The page as sections of blocks of lines."""
    kinds = [kind_of(line) for line in lines]
    at = [i for i, k in enumerate(kinds) if k != BLANK]
    named = title_line(lines, kinds, title)
    sections = [Section(0)]
    introduced = False  # the list that follows belongs to the text
    for n, i in enumerate(at):
        section, k = sections[-1], kinds[i]
        after = kinds[at[n + 1]] if n + 1 < len(at) else BLANK
        block = section.blocks[-1] if section.blocks else None
        if i == named or k == HEADING and (after in (PROSE, STEP, TABLE, INTRO) or named is None and len(sections) == 1 and _level(lines[i]) <= 2):
            sections.append(Section(_level(lines[i]) if k == HEADING else 1, [i]))
            introduced = False
            continue
        if k == INTRO and after not in (ITEM, STEP, TABLE):
            k = SHORT
        if k == SHORT and section.top and not section.blocks and dated(lines[i]):
            section.top.append(i)
            continue
        if k in (PROSE, STEP, TABLE, INTRO) or k == ITEM and introduced:
            if not block or not block.text:
                section.blocks.append(block := Block(True))
            block.lines.append(i)
            # a list that a text introduces is text, whatever its links
            block.points += points(bare(lines[i]) if k == ITEM else lines[i])
            introduced = k == INTRO or introduced and k == ITEM
            continue
        introduced = False
        if k == SHORT and block and block.text and after in (PROSE, STEP, TABLE, INTRO):
            block.between.append(i)  # one short line does not end a text
        elif not block or block.text or k == HEADING:
            section.blocks.append(Block(False, [i]))
        else:
            block.lines.append(i)
    return sections


def _level(line: str) -> int:
    text = line.strip().strip(_EDGES)
    return len(text) - len(text.lstrip("#")) or 1


def furniture(lines: list[str], title: str | None) -> list[int]:
    """Indexes of the lines, not blank, that are not of the main body."""
    sections = tree(lines, title)
    container = max(sections, key=Section.points)
    page = TO_PAGE * sum(b.points for s in sections for b in s.blocks)
    keep: set[int] = set()
    if page >= MIN_POINTS:
        best = max(b.points for b in container.blocks)
        for section in sections:
            bar = (INSIDE if section is container else BESIDE) * best
            own = [b for b in section.blocks if b.text and b.points >= bar]
            keep.update(i for b in own for i in b.lines)
            if own:
                keep.update(section.top or _heads(lines, section, own[0]))
    return [i for i, line in enumerate(lines) if i not in keep and line.strip().strip(_EDGES)]


def _heads(lines: list[str], section: Section, first: Block) -> list[int]:
    """The title, and a date below it, of a text that stands under no heading: the short lines right above it."""
    k = section.blocks.index(first)
    above, out = (section.blocks[k - 1].lines if k else []), []
    for i in reversed(above[-2:]):
        if kind_of(lines[i]) not in (SHORT, HEADING) or len(_PARTS.split(bare(lines[i]))) > 1 and not dated(lines[i]) or "](" in lines[i]:
            break
        out.append(i)
        if not dated(lines[i]):
            break
    return out


def furniture_lines(pages: DataFrame) -> DataFrame:
    """Lines, not blank, that are not of a page's main body: page_id, line_no (from 1, blank lines count).

    ``pages`` needs page_id, title and content; other columns are ignored. A page's row may be repeated; of differing
    rows each is judged by itself and the lines of all come out. Null and empty content gives no lines; a page without
    any body gives all of its lines. An empty table gives no rows.
    """
    pages = spread(pages.select(F.col("page_id").cast("long").alias("page_id"), "title", "content").where("page_id is not null and content is not null"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nos = [], []
            for page, title, content in zip(*(column(batch, c) for c in ("page_id", "title", "content"))):
                found = furniture(content.split("\n"), title)
                ids += [page] * len(found)
                nos += [i + 1 for i in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32())], names=["page_id", "line_no"])

    return pages.mapInArrow(rows, "page_id long, line_no int")


def main_bodies(pages: DataFrame) -> DataFrame:
    """Each page's main body: page_id and body (its lines in order; empty where there is none, null content: null).

    A row that is repeated with all its values comes out once; differing rows of one page_id come out each with its body.
    """
    pages = spread(pages.select(F.col("page_id").cast("long").alias("page_id"), "title", "content").where("page_id is not null").distinct())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies: list[str | None] = []
            for title, content in zip(column(batch, "title"), column(batch, "content")):
                lines = (content or "").split("\n")
                gone = set(furniture(lines, title))
                bodies.append(None if content is None else "\n".join(line for i, line in enumerate(lines) if i not in gone).strip())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string())], names=["page_id", "body"])

    return pages.mapInArrow(rows, "page_id long, body string")
