"""Worked-out cases of the text, address, HTML and layout functions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loam.functions import html as H
from loam.functions import layout as Y
from loam.functions import text as T
from loam.functions import urls as U


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column).first()[0]


def plain_tokens(text):
    cjk = lambda c: "一" <= c <= "鿿" or "㐀" <= c <= "䶿" or "\U00020000" <= c <= "\U0002a6df"
    out, word = [], ""
    low = text.lower()
    for i, c in enumerate(low + " "):
        if c.isalnum() and not cjk(c):
            word += c
            continue
        if word:
            out.append(word)
            word = ""
        if cjk(c):
            after = low[i + 1 : i + 2]
            out.append(c + after if after and cjk(after) else c)
    return out


@pytest.mark.parametrize(
    ("text", "want"),
    [("2026年同等学力 Hello-World, 报名x考试", "2026 年同 同等 等学 学力 力 hello world 报名 名 x 考试 试"), ("天气好", "天气 气好 好"), ("“abc” foo_bar ½ ² Ⅷ", "abc foo bar ½ ² ⅷ"), ("...!", ""), ("", ""), ("试𠀀𠀁", "试𠀀 𠀀𠀁 𠀁")],
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.col("t")), t=text) == want.split()


def test_tokens_of_random_texts(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("ab c1-天地人。x，\n") for _ in range(r.randint(0, 40))) for _ in range(200)]
    got = {x.t: x.k for x in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.tokens(F.col("t")).alias("k")).collect()}
    assert all(got[t] == plain_tokens(t) for t in texts)


@pytest.mark.parametrize(("text", "want"), [("2025年", 2025), ("2025-03", 2025), ("2025-13", 0), ("2025-3", 0), ("2024/0118", 2024), ("2025/03/18", 2025), ("2025/0344", 0), ("1999_12_31", 1999), ("1905年", 1905), ("2031_0230 2019-01", 2031), ("no", 0), (None, None)])
def test_max_year(spark, text, want):
    assert one(spark, T.max_year(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("---\na: 1\n---\n\nBody", "\n\nBody"), ("---\na: 1", "---\na: 1"), ("```yaml\na: 1\n```\nB", "\nB"), ("B", "B"), (None, None)])
def test_strip_front_matter(spark, text, want):
    assert one(spark, T.strip_front_matter(F.col("t")), t=text) == want


def test_front_matter_map(spark):
    assert one(spark, T.front_matter_map(F.col("t")), t="---\na: 1: 2\nb:x\na: 3\nno\n---\nc: 4") == {"b": "x", "a": "3"}
    assert one(spark, T.front_matter_map(F.col("t")), t="c: 4") == {}


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://h.com/a/b/?x=1#f", "https://h.com/a/b?x=1"), ("https://h.com", "https://h.com/"), ("https://h.com///", "https://h.com/"), ("HTTP://H.com/A;p/", "http://H.com/A;p"), ("http://h/a;p", "http://h/a"), ("https://h.com/a?b=2&a=1", "https://h.com/a?b=2&a=1")],
)
def test_normalize_url(spark, url, want):
    assert one(spark, U.normalize_url(F.col("u")), u=url) == want


@pytest.mark.parametrize(("path", "want"), [("/docs/a b.html", "docs_a_b_html"), ("/", "index"), ("", "index"), ("/政策/通知-1.html", "政策_通知-1_html"), ("/" + "x" * 300, "x" * 200)])
def test_filename(spark, path, want):
    assert one(spark, U.filename_of(F.col("u")), u=f"https://h.com{path}") == want


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://h.com/abs", True), ("https://h.com/abs/x", True), ("https://h.com/absolute", False), ("https://h.com/abs/2602.01478", True), ("https://h.com/pdf/2602.01478", True), ("https://h.com/other/x.pdf", True), ("https://g.com/x.pdf", False),
     ("https://h.com/abs/x.css", False), ("https://h.com/abs/x.docx", False), ("https://h.com/abs/x.html", True), ("https://h.com/other/x.html", False)],
)
def test_should_process(spark, url, want):
    assert one(spark, U.should_process(F.col("u"), ["https://h.com/abs"], [".pdf"]), u=url) is want


def test_result_links(spark):
    links = U.result_links(F.col("k"), F.col("o"), F.col("q"), F.col("b"))
    row = spark.createDataFrame([("s.com/a_b", "out put", "学 x*", "b~")], "k string, o string, q string, b string").select(*[c.alias(n) for n, c in links.items()]).first()
    assert row.md_download_url == "/files/s.com/docs/a_b.md?output_dir=out+put"
    assert row.html_view_url.endswith("&highlight=%E5%AD%A6+x*") and row.html_block_view_url.endswith("&highlight_block=b%7E")


def test_snippet(spark):
    text = "0123456789" * 5 + " Word\r\nnext " + "z" * 200
    cut = one(spark, T.snippet(F.col("t"), F.array(F.lit("nope"), F.lit("word"))), t=text)
    assert cut == "..." + text[21:141].replace("\n", " ").replace("\r", "").strip() + "..."
    assert one(spark, T.snippet(F.col("t"), F.array(F.lit("nope"))), t=" short ") == "short"


PAGE = """<html><head><title>T &amp; t</title><style>p{}</style><script>"</p>"</script></head><body><nav><a href=/n>Nav</a></nav>
<div class="content"><h1>The &lt;real&gt; title</h1><p>One <b>bold<p>Two<a href="/x#y">link</a><a href="mailto:a@b">m</a><a href="/x#y">again</a>
<table><tr><td rowspan=2>a|b<td>bar<br>baz</tr><tr><td colspan="x">c</tr></table><ul><li>i<li>j</ul></div><footer>F"""


def test_html_page(spark):
    df = spark.createDataFrame([(PAGE, "https://h.com/a/"), (None, None), ("", None), ("<p>" * 3000, None)], "h string, u string")
    page, none, empty, deep = (r[0] for r in df.select(H.html_page("h", "u")).collect())
    assert page.title == "The <real> title" and page.true_title == "The <real> title"
    assert page.links == ["https://h.com/n", "https://h.com/x#y"]
    assert "# The <real> title" in page.markdown and "- i\n- j" in page.markdown and "Nav" not in page.markdown
    assert "| a\\|b | bar<br>baz |\n| --- | --- |\n|  | c |" in page.markdown
    assert none.title is None and empty.title == "Untitled" and deep.markdown == ""


def test_spans_fill_the_grid():
    table = H.first(H.parse("<table><tr><th colspan=2>a<th rowspan=2>b<tr><td>c<td>d</table>"), "table")
    assert H.table_grid(table) == [["a", "", "b"], ["c", "d", ""]]


def test_body_only(spark):
    texts = ["menu\n当前位置：首页\n>\n栏目\n这是一段正文，足够长。\n\n\n\n关于我们\nx", "关于我们\nno trail\n\n版权所有 x", "当前位置:a\n\nb", "", None, "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [x[0] for x in df.orderBy("i").select(H.body_only(F.col("t"))).collect()]
    assert got == ["当前位置：首页 > 栏目\n这是一段正文，足够长。", "关于我们\nno trail", "当前位置:a b", "", None, "plain"]


def test_layout():
    line = lambda t, y, x=60.0, s=10.5: {"text": t, "size": s, "y0": y, "x0": x}
    lines = [line("Title", 10, s=16), line("one", 40), line("two", 52), line("c", 71, 200), line("a", 70), line("b", 73.9, 130), line("1. listed", 90), line("far", 140), line("1", 160), line("2", 160, 100), line("3", 160, 140), line("4", 160, 180)]
    assert Y.layout_markdown(lines) == "# Title\n\n　　onetwo\n\n| a | b | c |\n|---|---|---|\n\n　　1. listed\n\n　　far\n\n| 1 | 2 | 3 | 4 |\n|---|---|---|---|\n".rstrip("\n") + "\n"
    assert Y.layout_markdown([]) == "" == Y.layout_markdown(None)


def test_best_window():
    text = "alpha " + "x" * 2000 + " alpha beta beta"
    assert Y.best_window(text, ["alpha", "beta"]) == (2007, 2017)
    assert Y.best_window(text, ["none"]) == (-1, -1)


def test_located(spark):
    from loam.functions import show as W

    text, block = "Intro. " + "Some words, here " * 3 + "the end!", "Some words; here some words here some words here the end"
    row = spark.createDataFrame([(text, block, "tiny"), (text, "not in the text at all", None)], "t string, b string, s string").select(W.located(F.col("t"), F.col("b")).alias("a"), W.located(F.col("t"), F.col("s")).alias("s")).collect()
    clean = "".join(c for c in text if c.isalnum())
    assert (row[0].a.start, row[0].a.end) == (-1, -1)  # letter case counts
    assert (row[0].s.start, row[1].a.start) == (-1, -1)
    same = spark.createDataFrame([(text, text[8:])], "t string, b string").select(W.located(F.col("t"), F.col("b")).alias("a")).first().a
    assert (same.start, same.end) == (6, len(clean))


def test_keywords_marks_and_base(spark):
    from loam.functions import show as W

    assert one(spark, W.keywords(F.col("q")), q="学历证明，ab c") == ["学历证明", "ab", "学历", "历证", "证明", "c"]
    row = spark.createDataFrame([("a <b> Word word c", "word c")], "s string, q string").select(W.marked(F.col("s"), F.col("q"))).first()
    assert row[0] == "a &lt;b&gt; <mark>Word</mark> <mark>word</mark> c"
    df = spark.createDataFrame([("<html><HEAD x><b>", "http://h"), ("<b>", "http://h"), ("<b>", None)], "p string, u string")
    assert [r[0] for r in df.select(W.with_base(F.col("p"), F.col("u"))).collect()] == ['<html><HEAD x>\n<base href="http://h"><b>', '<base href="http://h">\n<b>', "<b>"]


def test_markdown_html():
    from loam.functions.show import markdown_html

    text = "# T & t\n\npara **b** ~~s~~ [l](http://x) [j](javascript:y)\nmore\n\n- a\n- b\n\n1. c\n\n| h | i |\n| --- | --- |\n| 1 | a\\|b |\n\n```\n<x>\n```\n> q"
    out = markdown_html(text)
    for part in ("<h1>T &amp; t</h1>", "<strong>b</strong> <del>s</del> <a href=\"http://x\">l</a> [j](javascript:y)\nmore</p>", "<ul><li>a</li><li>b</li></ul>", "<ol><li>c</li></ol>", "<tr><td>1</td><td>a|b</td></tr>", "<pre><code>&lt;x&gt;</code></pre>", "<blockquote><p>q</p></blockquote>"):
        assert part in out
    assert markdown_html("") == ""
