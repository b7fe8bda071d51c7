"""The main body: pages put together from known parts, and cases at the edges."""

from __future__ import annotations

import random

from loam.llm import main_body as M

NAV = ["Home", "About us", "Careers", "Log in"]
PROSE = ["The office moved last year, and the move took nine weeks. Nobody lost a file.", "评审组抽查了四百份表格，发现十份缺页，已通知有关单位补交。", "After lunch, the committee read the report; it found no fault with it."]


def page(r, k):
    """(lines, numbers of the lines that are no main body, title)."""
    title = f"Guide number {k} to the library"
    parts = [(x, True) for x in r.sample(NAV, 3)] + [("You are here: Home > Guides", True), ("", None), (f"# {title}", False), ("2024-03-05, Library Office", False), (r.choice(PROSE), False)]
    parts += r.choice([[("### Latest", True), (f"- [Other page {k}](/a.html)", True), ("- [One more](/b.html)", True)], [("Like (12)  Save  Share", True)], []])
    parts += [(r.choice(PROSE), False), ("Please bring:", False), ("- a card", False), ("* [a form](/form.html)", False), ("Q: May I leave early?", False), ("A: Yes.", False)]
    parts += [("| Name | Date |", False), ("| --- | --- |", False), ("| A | 2024 |", False), (r.choice(PROSE), False)]
    parts += [("", None), (f"The {r.choice('ABC')}ton Board is a body of {r.choice('XYZ')}ford.", True), ("Privacy | Terms | Contact", True)]
    return [x for x, _ in parts], [i for i, (_, f) in enumerate(parts, 1) if f], title


def test_made_pages(spark):
    r = random.Random(1)
    pages = [page(r, k) for k in range(40)]
    rows = [(k, t if k % 5 else None, "\n".join(x) if k % 7 else "\r\n".join(x), "x") for k, (x, _, t) in enumerate(pages)]
    df = spark.createDataFrame(rows + rows[:3], "page_id long, title string, content string, line_no string")
    got: dict[int, set[int]] = {}
    for x in M.furniture_lines(df).collect():
        got.setdefault(x.page_id, set()).add(x.line_no)
    for k, (lines, f, _) in enumerate(pages):
        # a footer that is a sentence, right below the text, has points like any paragraph of its length: tree scoring keeps it
        sentence = {i for i in f if " is a body of " in lines[i - 1]}
        assert got[k] | sentence == set(f)
    body = {x.page_id: x.body for x in M.main_bodies(df).collect()}
    assert body[1].startswith("# Guide number 1") and "Privacy" not in body[1]


def test_edges(spark):
    index = "Home\nNews\n### Most read\n1. [One](/1)\n2. [Two](/2)\nPrivacy | Terms"
    rows = [(1, "t", None), (2, None, ""), (3, "Most read", index), (4, None, "\n \n　"), (5, "T", "# T\n" + "A long line, and then some more. " * 20_000), (None, "t", "x")]
    df = spark.createDataFrame(rows, "page_id long, title string, content string")
    got: dict[int, set[int]] = {}
    for x in M.furniture_lines(df).collect():
        got.setdefault(x.page_id, set()).add(x.line_no)
    assert got == {3: {1, 2, 3, 4, 5, 6}}
    assert M.furniture_lines(df.where("false")).count() == 0


def test_kinds():
    cases = {"| a | b |": M.TABLE, "- x": M.ITEM, "3. x": M.ITEM, "# x": M.HEADING, "问：可以吗？": M.PROSE, "文号：12": M.SHORT, "Step 3: go": M.STEP, "步骤：": M.INTRO, "Home | News | Help": M.SHORT, "　": M.BLANK, PROSE[0]: M.PROSE, PROSE[1]: M.PROSE}
    assert {k: M.kind_of(k) for k in cases} == cases


def test_link_density():
    assert M.link_density("[all of it](/x)") == 1
    assert M.link_density("none") == 0


def scored(lines, title=None):
    return [(round(s.points(), 2), len(s.blocks)) for s in M.tree(lines, title)]


def test_points_pass_to_the_ancestors():
    text = "Ten commas, or fewer, pass points to the block, the section and the page."
    assert M.points(text) == len(text) / 100 + 1.5
    assert M.points(f"[{text}](/x)") == 0
    assert scored(["# T", text, "Home", "News", text]) == [(0.0, 0), (round(M.TO_SECTION * 2 * M.points(text), 2), 3)]


def test_best_container_and_siblings():
    text = "The committee met in March, read the report, and found no fault with it; the minutes, as always, are public."
    lines = ["We use small files, as you know.", "# T", text, text, "## More", text, text, "### Links", "- [one](/1)", "- [two](/2)", "### Own", "Short, but here."]
    assert M.furniture(lines, "T") == [0, 7, 8, 9, 10, 11]
    assert M.furniture(["Home", "About", "### Links", "- [one](/1)"], "T") == [0, 1, 2, 3]


def test_introduced_list_is_text_and_others_are_not():
    lines = ["# T", "Attachments:", "- [a signed form of two pages, with a stamp](/f)", "- a card", "Home", "- [other page](/o)"]
    assert M.furniture(lines, "T") == [4, 5]


def test_differing_rows_of_one_page(spark):
    text = "The committee met in March, read the report, and found no fault with it."
    df = spark.createDataFrame([(1, "T", f"# T\n{text}\nHome"), (1, "T", f"# T\n{text}\nHome"), (1, "T", f"Home\n# T\n{text}")], "page_id long, title string, content string")
    assert [x.body for x in M.main_bodies(df).collect()] == [f"# T\n{text}"] * 2
