"""What a reader is shown: marked snippets, located passages, previews."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.text import strip_front_matter

_KEPT = r"[^\x{4e00}-\x{9fa5}a-zA-Z0-9]"
_PUNCTUATION = r"[\s,，.。;；!！?？、()（）\[\]【】《》<>\"'’‘“”:]+"
_PIECES = r"(?=([\x{4e00}-\x{9fa5}]{2}|[a-zA-Z0-9]{2,}))(?:[\x{4e00}-\x{9fa5}]|[a-zA-Z0-9]+)"


def located(text: Column, block: Column, edge: int = 20) -> Column:
    """Where a passage stands in a text, both without all but letters, ideographs and digits: struct(start, end).

    It is looked for by its first and last ``edge`` characters. Not found, or under five characters: -1 and -1.
    """
    whole, part = F.regexp_replace(text, _KEPT, ""), F.regexp_replace(block, _KEPT, "")
    prefix, suffix = F.substring(part, 1, edge), F.right(part, F.lit(edge))
    start = F.call_function("locate", prefix, whole, F.lit(1))
    end = F.call_function("locate", suffix, whole, F.greatest(start, F.lit(1)))
    found = (F.length(part) >= 5) & (start > 0) & (end > 0)
    none = F.lit(-1)
    return F.struct(F.when(found, start - 1).otherwise(none).alias("start"), F.when(found, end - 1 + F.length(suffix)).otherwise(none).alias("end"))


def keywords(query: Column) -> Column:
    """Words to mark for a query, the longest first: its parts between punctuation, pairs of ideographs, Latin runs."""
    parts = F.filter(F.split(query, _PUNCTUATION), lambda w: F.trim(w) != "")
    pieces = F.regexp_extract_all(query, F.lit(_PIECES), F.lit(1))
    words = F.array_distinct(F.concat(parts, pieces))
    order = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return F.transform(order, lambda s: s["w"])


def marked(snippet: Column, query: Column) -> Column:
    """A snippet as HTML with the query's words marked; one Latin letter alone is not."""
    words = F.filter(F.split(F.trim(query), r"\s+"), lambda w: (F.length(w) >= 2) | w.rlike(r"[\x{4e00}-\x{9fa5}]"))
    safe = F.replace(F.replace(snippet, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    quoted = lambda w: F.concat(F.lit("(?i)(\\Q"), F.replace(w, F.lit("\\E"), F.lit("")), F.lit("\\E)"))
    return F.aggregate(words, safe, lambda text, w: F.regexp_replace(text, quoted(w), F.lit("<mark>$1</mark>")))


def percent(score: Column) -> Column:
    """A score from 0 to 1 in percent with one decimal."""
    return F.concat(F.format_number(score * 100, 1), F.lit("%"))


def with_base(page: Column, url: Column) -> Column:
    """A page whose relative links lead where they led at ``url``; null address: the page as it is."""
    tag = F.concat(F.lit('<base href="'), url, F.lit('">'))
    head = F.regexp_extract(page, r"(?i)(<head[^>]*>)", 1)
    at = F.call_function("locate", head, page, F.lit(1)) + F.length(head)
    inside = F.concat(F.substring(page, F.lit(1), at - 1), F.lit("\n"), tag, F.substring(page, at, F.length(page)))
    return F.when(url.isNull(), page).when(head != "", inside).otherwise(F.concat(tag, F.lit("\n"), page))


def markdown_html(text: str) -> str:
    """Markdown as HTML: headings, paragraphs, lists, tables, quotes, fenced code, links, bold, italic, struck out."""
    out: list[str] = []
    lines = (text or "").replace("\r\n", "\n").split("\n")
    i = 0
    while i < len(lines):
        line = lines[i].strip()
        if line.startswith("```"):
            end = next((k for k in range(i + 1, len(lines)) if lines[k].strip().startswith("```")), len(lines))
            out.append("<pre><code>" + html.escape("\n".join(lines[i + 1 : end]), quote=False) + "</code></pre>")
            i = end + 1
            continue
        run, kind = [line], _kind(line)
        while kind not in ("", "h") and i + len(run) < len(lines) and _kind(lines[i + len(run)].strip()) == kind:
            run.append(lines[i + len(run)].strip())
        out.append(_block(kind, run))
        i += len(run)
    return "\n".join(filter(None, out))


def _kind(line: str) -> str:
    if not line:
        return ""
    for kind, pattern in (("h", r"#{1,6}\s"), ("ul", r"[-*+]\s"), ("ol", r"\d+[.)]\s"), ("q", r">"), ("t", r"\|.*\|$"), ("code", r"```")):
        if re.match(pattern, line):
            return kind
    return "p"


def _block(kind: str, run: list[str]) -> str:
    if kind == "h":
        level = len(run[0]) - len(run[0].lstrip("#"))
        return f"<h{level}>{_inline(run[0].lstrip('#').strip())}</h{level}>"
    if kind in ("ul", "ol"):
        return f"<{kind}>" + "".join(f"<li>{_inline(re.sub(r'^(?:[-*+]|[0-9]+[.)])\s+', '', x))}</li>" for x in run) + f"</{kind}>"
    if kind == "q":
        return "<blockquote><p>" + "\n".join(_inline(x.lstrip("> ")) for x in run) + "</p></blockquote>"
    if kind == "t" and len(run) > 1 and re.fullmatch(r"\|[-:| ]+\|", run[1]):
        cells = lambda row, tag: "<tr>" + "".join(f"<{tag}>{_inline(c.strip())}</{tag}>" for c in re.split(r"(?<!\\)\|", row.strip("|"))) + "</tr>"
        return "<table><thead>" + cells(run[0], "th") + "</thead><tbody>" + "".join(cells(x, "td") for x in run[2:]) + "</tbody></table>"
    return "<p>" + "\n".join(map(_inline, run)) + "</p>" if kind else ""


def _inline(text: str) -> str:
    out = html.escape(text, quote=False).replace("\\|", "|")
    out = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)\)", r'<img alt="\1" src="\2">', out)
    out = re.sub(r"\[([^\]]*)\]\(((?!javascript:)[^)\s]+)\)", r'<a href="\2">\1</a>', out)
    for mark, tag in ((r"\*\*", "strong"), ("~~", "del"), (r"\*", "em")):
        out = re.sub(rf"{mark}(?=\S)(.+?)(?<=\S){mark}", rf"<{tag}>\1</{tag}>", out)
    return out


@F.pandas_udf(T.StringType())
def _markdown_html(texts: pd.Series) -> pd.Series:
    return texts.map(markdown_html)


def preview(content: Column, extension: Column) -> Column:
    """A stored file as HTML: Markdown rendered without its front matter, pages as they are, other texts literally."""
    escaped = content
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(char), F.lit(entity))
    return (
        F.when(extension == ".md", _markdown_html(strip_front_matter(F.ltrim(content))))
        .when(extension.isin(".html", ".htm"), content)
        .otherwise(F.concat(F.lit("<pre><code>"), escaped, F.lit("</code></pre>")))
    )
