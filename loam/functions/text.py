"""Column expressions over texts: tokens, front matter, years, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ideographs that are cut into pairs; kana and hangul form words like letters do.
CJK = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}"
_WORD = rf"[\p{{IsAlphabetic}}\p{{N}}&&[^{CJK}]]+"
_TOKEN = rf"(?=([{CJK}]{{1,2}}|{_WORD}))(?:[{CJK}]|{_WORD})"
_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def tokens(text: Column) -> Column:
    """Lower-case words; a run of n ideographs gives its n - 1 pairs and its last character. Null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(1))


def strip_front_matter(text: Column) -> Column:
    """``text`` without the block between ``---`` lines (or a yaml fence) at its head; an unclosed block stays."""
    close = F.call_function("locate", F.lit("\n---"), text, F.lit(4))
    fence = F.call_function("locate", F.lit("\n```"), text, F.lit(4))
    rest = lambda at: F.call_function("substring", text, at + 4, F.length(text))
    return (
        F.when(F.startswith(text, F.lit("---")) & (close > 0), rest(close))
        .when((F.startswith(text, F.lit("```yaml")) | F.startswith(text, F.lit("```ymal"))) & (fence > 0), rest(fence))
        .otherwise(text)
    )


def front_matter_map(text: Column) -> Column:
    """The ``key: value`` lines of the front matter as a map; of repeated keys the last holds; none: an empty map."""
    block = F.regexp_extract(text, r"^---\r?\n([\s\S]*?)\r?\n---", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda line: line.rlike(r"^[^:\s][^:]*:"))
    pair = lambda line: F.struct(F.trim(F.regexp_extract(line, "^([^:]+):", 1)).alias("k"), F.trim(F.regexp_extract(line, r"^[^:]+:\s*([\s\S]*)$", 1)).alias("v"))
    pairs = F.transform(lines, pair)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


#: Years as they stand in addresses and texts; the month and day must be ones.
YEAR_PATTERNS = (
    r"((?:19|20)\d{2})年",
    r"((?:19|20)\d{2})-(?:0[1-9]|1[0-2])(?![0-9])",
    r"((?:19|20)\d{2})/(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?![0-9])",
    r"((?:19|20)\d{2})/(?:0[1-9]|1[0-2])(?![0-9])",
    r"((?:19|20)\d{2})_(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?![0-9])",
    r"((?:19|20)\d{2})_(?:0[1-9]|1[0-2])(?![0-9])",
)


def front_matter(fields: dict[str, Column]) -> Column:
    """The fields as ``key: value`` lines between ``---`` lines; null values are left out, line ends become spaces."""
    shown = [F.when(value.isNotNull(), F.concat(F.lit(f"{key}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "))) for key, value in fields.items()]
    return F.concat(F.lit("---\n"), F.array_join(F.array(*shown), "\n"), F.lit("\n---\n\n"))


def max_year(text: Column) -> Column:
    """The latest year in ``text``, 1900 to 2099; 0 where there is none, null for null."""
    years = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in YEAR_PATTERNS]))
    return F.when(text.isNotNull(), F.coalesce(F.array_max(F.transform(years, lambda y: y.cast("int"))), F.lit(0)))


def snippet(content: Column, query_tokens: Column, before: int = 30, size: int = 120) -> Column:
    """``size`` characters around the first query token (in query order) that stands in ``content``; else its head."""
    lowered = F.lower(content)
    first = F.filter(query_tokens, lambda t: F.call_function("instr", lowered, t) > 0)
    at = F.when(F.size(first) > 0, F.call_function("instr", lowered, F.get(first, F.lit(0))) - 1).otherwise(0)
    start = F.greatest(at - before, F.lit(0))
    cut = F.call_function("substring", content, start + 1, F.lit(size))
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(cut, "\n", " "), "\r", ""), rf"^{_SPACE}+|{_SPACE}+$", "")
    return F.concat(F.when(start > 0, "...").otherwise(""), flat, F.when(start + size < F.length(content), "...").otherwise(""))


def lines(content: Column) -> Column:
    """The lines of ``content`` without their ends; a line end at the very end starts no line."""
    return F.transform(F.split(F.regexp_replace(content, r"\r?\n$", ""), "\n", -1), lambda x: F.regexp_replace(x, r"\r$", ""))


def plain_wrapped(content: Column, extension: Column) -> Column:
    """Data files as a fenced block named after their extension (``yml`` as yaml); other texts as they are."""
    name = F.when(extension == "yml", "yaml").otherwise(extension)
    return F.when(extension.isin("json", "xml", "yaml", "yml", "csv"), F.concat(F.lit("```"), name, F.lit("\n"), content, F.lit("\n```"))).otherwise(content)


def escaped_preview(content: Column) -> Column:
    """A text as an HTML block that shows it literally."""
    out = content
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return F.concat(F.lit("<pre>"), out, F.lit("</pre>"))


def highlight_terms(block: Column) -> Column:
    """Terms to mark when a block is shown: its words without markup; long ones in pieces of five characters."""
    bare = F.regexp_replace(block, r"!\[[^\]]*\]\([^)]*\)", " ")
    bare = F.regexp_replace(bare, r"\[([^\]]*)\]\([^)]*\)", "$1")
    bare = F.regexp_replace(bare, r"<https?://[^>]*>", " ")
    words = F.transform(F.split(bare, r"[\s|]+"), lambda w: F.regexp_replace(w, r"[^\x{4e00}-\x{9fa5}a-zA-Z0-9]", ""))
    words = F.filter(words, lambda w: w != "")
    chunks = lambda w: F.filter(F.regexp_extract_all(w, F.lit("(.{1,5})"), F.lit(1)), lambda c: F.length(c) >= 2)
    long = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > 8, chunks(w)).when(F.length(w) >= 2, F.array(w)).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.when(F.size(long) > 0, long).otherwise(words))
