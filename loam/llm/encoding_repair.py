"""Text that was decoded with the wrong character encoding: found and, where it can be, restored.

Each suspicious line is the start of a best-first search. An edge encodes (parts of) the text as a codec would and
decodes the bytes with another, or undoes escapes; states are remembered by their hash, the cheapest open one is expanded
first, and the cost is how implausible the characters and their neighbourhoods are. The cheapest text that was reached is
the restored one. A scan of all characters at once picks the lines to search.
"""

from __future__ import annotations

import heapq
import html
import re
import urllib.parse
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.textbytes import chunks, code_points, column
from loam.sources.scratch import spread

#: States expanded for a line at most, where the caller sets no other number; a garbled line needs about as many as it
#: was wrongly decoded. Lines whose search this ends are reported.
MAX_STATES = 24
#: How much cheaper the restored text must be.
MIN_GAIN = 1.0
LOST = "�"

# Classes of characters.
(LOWER, UPPER, PLAIN, ACCENT, ACCENT_UP, SIGN, QUOTE, LATIN_EXT, HAN_COMMON, HAN_LEVEL2, HAN_RARE, WIDE, HALF_KANA, KANA, BOPOMOFO, PRIVATE, CONTROL,
 REPLACED, GREEK_CYR, EMOJI, HANGUL, MATH, OTHER, BOX, NBSP, KUN) = range(26)
#: What a character of each class costs, in the order of the classes.
_COST = np.array([0, 0, 0, 0.25, 0.5, 0.7, 0.3, 0.8, 0, 0.15, 1.2, 0, 1.5, 0.5, 2, 3, 4, 3, 0.2, 0.3, 0.4, 1, 1, 2, 0.3, 3.5])
_EUROPEAN = (ACCENT, ACCENT_UP, SIGN, QUOTE, LATIN_EXT, GREEK_CYR, MATH, NBSP)
_HAN = (HAN_COMMON, HAN_LEVEL2, HAN_RARE, KUN)


@cache
def _classes() -> np.ndarray:
    """Class of each code point. Which Han characters are common follows from the two levels of GB 2312."""
    c = np.full(0x110000, OTHER, dtype=np.uint8)
    c[:0x80] = PLAIN
    c[ord("a") : ord("z") + 1] = LOWER
    c[ord("A") : ord("Z") + 1] = UPPER
    c[:0x20] = CONTROL
    c[[9, 10, 13]] = PLAIN
    c[0x7F:0xA0] = CONTROL
    c[0xA0:0xC0] = SIGN
    c[0xA0] = NBSP
    c[0xC0:0xDF] = ACCENT_UP
    c[0xDF:0x100] = ACCENT
    c[[0xD7, 0xF7]] = SIGN
    c[0x100:0x250] = LATIN_EXT
    c[[0x152, 0x160, 0x17D, 0x178]] = ACCENT_UP
    c[[0x153, 0x161, 0x17E]] = ACCENT
    c[0x370:0x530] = GREEK_CYR
    c[0x250:0x370] = BOX  # phonetic letters and combining marks: rare in running text, frequent where bytes are misread
    c[0x2000:0x2070] = QUOTE
    c[[0x20AC, 0x2122, 0x192, 0x2C6, 0x2DC]] = QUOTE
    c[0x2190:0x2300] = MATH
    c[0x25CA] = MATH
    c[0x2D8:0x2DE] = MATH
    c[0xFB01:0xFB03] = MATH
    c[0x2500:0x25A0] = BOX
    c[0x2600:0x27C0] = EMOJI
    c[0x1F000:0x1FB00] = EMOJI
    c[0x1100:0x1200] = HANGUL
    c[0xAC00:0xD7B0] = HANGUL
    c[0x3000:0x3040] = WIDE
    c[0xFF00:0xFF61] = WIDE
    c[0xFFE0:0xFFE7] = WIDE
    c[0x3040:0x3100] = KANA
    c[0xFF61:0xFFA0] = HALF_KANA
    c[0x3100:0x3130] = BOPOMOFO
    c[0xFE30:0xFE70] = BOPOMOFO
    c[0x3400:0xA000] = HAN_RARE
    c[0xF900:0xFB00] = HAN_RARE
    c[0x20000:0x32000] = HAN_RARE
    for lead in range(0xB0, 0xF8):
        for trail in range(0xA1, 0xFF):
            try:
                c[ord(bytes((lead, trail)).decode("gb2312"))] = HAN_COMMON if lead < 0xD8 else HAN_LEVEL2
            except UnicodeDecodeError:
                continue
    c[0xE000:0xF900] = PRIVATE
    c[0xF0000:0x110000] = PRIVATE
    c[0xFFFD] = REPLACED
    c[ord("锟")] = KUN  # the bytes of two replacement characters, read as GBK
    return c


@cache
def _neighbours() -> np.ndarray:
    """What a character of one class after one of another costs besides."""
    n = np.zeros((26, 26))
    n[np.ix_(_EUROPEAN, _EUROPEAN)] = 0.8
    n[GREEK_CYR, GREEK_CYR] = 0
    n[ACCENT, ACCENT] = 0.2
    n[LOWER, GREEK_CYR] = n[GREEK_CYR, LOWER] = 0.8
    n[LOWER, ACCENT_UP] = n[LOWER, SIGN] = n[LOWER, MATH] = n[SIGN, LOWER] = 0.8
    n[np.ix_((LOWER, UPPER, ACCENT), _HAN)] = 0.8
    n[np.ix_(_HAN, (LOWER, UPPER, ACCENT))] = 0.8
    return n


def cost(text: str) -> float:
    """How implausible ``text`` is, by its characters and their neighbours."""
    if not text:
        return 0.0
    c = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    return float(_COST[c].sum() + _neighbours()[c[:-1], c[1:]].sum())


# --- edges -----------------------------------------------------------------------------------------------------------

_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
#: Encodings of one byte a character through which bytes may have been read, with the classes that hint at them.
SINGLE = {
    "cp1252": (ACCENT, ACCENT_UP, SIGN, CONTROL),
    "mac_roman": (MATH, ACCENT_UP, SIGN, ACCENT),
    "cp437": (BOX,),
    "cp850": (BOX,),
    "cp1251": (GREEK_CYR,),
    "koi8_r": (GREEK_CYR,),
    "cp1250": (LATIN_EXT,),
}
#: Encodings of several bytes a character, likewise.
MULTI = {
    "gb18030": (HAN_RARE, PRIVATE, REPLACED, KUN, HAN_COMMON),
    "big5hkscs": (BOPOMOFO, HAN_RARE),
    "cp932": (HALF_KANA,),
    "cp949": (HANGUL,),
}
#: A lone Han character can come from any two bytes.
_HAN_RUN = re.compile("[\u4e00-\u9fff]{2}")
_BREAKS = re.compile(r"[^，。；、！？《》\n]+")


@cache
def _single(codec: str) -> tuple[dict[int, int], re.Pattern, re.Pattern]:
    """Code point to byte, runs of its non-ASCII characters, runs of all of its characters."""
    to_byte = {}
    for b in range(0x80, 0x100):
        try:
            to_byte[ord(bytes((b,)).decode(codec))] = b
        except UnicodeDecodeError:
            pass
        if codec == "cp1252":  # bytes it leaves open, and what a lenient reader keeps
            to_byte.setdefault(b, b)
    high = "".join(re.escape(chr(c)) for c in sorted(to_byte))
    return to_byte, re.compile(f"[{high}]{{2,}}"), re.compile(f"[\x00-\x7f{high}]*[{high}][\x00-\x7f{high}]*")


def utf8_read_as(text: str, codec: str) -> str:
    """Whatever in ``text`` is a valid UTF-8 sequence under ``codec``, decoded; the rest as it is."""
    to_byte, runs, _ = _single(codec)

    def decoded(m: re.Match) -> str:
        run = m.group()
        raw, out, last = run.translate(to_byte).encode("latin-1"), [], 0
        for s in _UTF8.finditer(raw):
            try:
                good = s.group().decode("utf-8")
            except UnicodeDecodeError:
                continue
            out += [run[last : s.start()], good]
            last = s.end()
        return "".join([*out, run[last:]])

    return runs.sub(decoded, text)


def double_byte_read_as(text: str, codec: str, true: str) -> str:
    """Runs of ``codec`` characters, encoded and decoded as ``true`` where that makes them more plausible."""
    to_byte, _, spans = _single(codec)

    def decoded(m: re.Match) -> str:
        good = m.group().translate(to_byte).encode("latin-1").decode(true, "replace")
        return good if _HAN_RUN.search(good) and cost(good) + 0.5 < cost(m.group()) else m.group()

    return spans.sub(decoded, text)


def _encoded(text: str, codec: str) -> bytes | None:
    out = []
    for ch in text:
        if ch == LOST:
            out.append(b"\xff")
        elif "\x80" <= ch < "\xa0":
            out.append(bytes((ord(ch),)))
        else:
            try:
                out.append(ch.encode(codec))
            except UnicodeEncodeError:
                return None
    return b"".join(out)


def _better(good: str, text: str) -> bool:
    """Whether ``good`` is plausible by itself and more so than ``text``."""
    return cost(good) + 0.5 < min(cost(text), 0.45 * sum(ch > "\x7f" for ch in good) + 2)


def multi_read_as(text: str, codec: str, true: str) -> str:
    """Stretches between Chinese punctuation, encoded as ``codec`` and decoded as ``true`` where that helps."""

    def decoded(m: re.Match) -> str:
        raw = _encoded(m.group(), codec)
        if raw is None or raw.isascii():
            return m.group()
        good = raw.decode(true, "replace")
        return good if _better(good, m.group()) else m.group()

    whole = _encoded(text, codec)
    if whole is not None:
        good = whole.decode(true, "replace")
        if _better(good, text):
            return good
    return _BREAKS.sub(decoded, text)


def unescaped(text: str) -> str:
    """HTML entities, percent and backslash escapes undone."""
    out = html.unescape(text)
    out = re.sub(r"(?:%[0-9A-Fa-f]{2})+", lambda m: urllib.parse.unquote(m.group(), errors="strict") if _is_utf8(m.group()) else m.group(), out)
    return re.sub(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1] or m[2], 16)), out)


def _is_utf8(escaped: str) -> bool:
    try:
        urllib.parse.unquote_to_bytes(escaped).decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _edges(text: str) -> Iterator[tuple[bool, str]]:
    """(whether encodings were changed, text) of every state next to ``text``."""
    present = set(np.unique(_classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]).tolist())
    for codec, hints in SINGLE.items():
        if present.intersection(hints):
            yield True, utf8_read_as(text, codec)
            if codec in ("cp1252", "mac_roman", "cp437", "cp850"):
                yield True, double_byte_read_as(text, codec, "gb18030")
            if codec == "cp1252":
                yield True, double_byte_read_as(text, codec, "cp932")
                yield True, double_byte_read_as(text, codec, "big5hkscs")
    for codec, hints in MULTI.items():
        if present.intersection(hints):
            yield True, multi_read_as(text, codec, "utf-8")
            if codec != "gb18030":
                yield True, multi_read_as(text, codec, "gb18030")
    if "&" in text or "%" in text or "\\" in text:
        yield False, unescaped(text)


#: A garbled sign that is quoted on purpose: alone between quotation marks, or after a word for sign.
_PLAIN = r"\x00-\x7f\u3000-\u303f\u4e00-\u9fff\uff00-\uff60"
_QUOTED = re.compile(rf"""(?<![^{_PLAIN}])[“"„«‹「『‘'`][^\x00-\x7f“”„«»‹›「」『』‘’]{{1,8}}[”"“»›」』’'`](?![^{_PLAIN}])""")
_NAMED = re.compile(r"((?:\b(?:sign|symbol|character|mark|Zeichen|Symbol|signe|symbole|caractère)s?|符号|字符)\s*)" + LOST + r"(?=\s|$|[,.;:，。；：])", re.IGNORECASE)


def without_mentions(text: str) -> str:
    """``text`` with the signs that it only mentions taken out."""
    return _NAMED.sub(r"\1", _QUOTED.sub("", text))


@lru_cache(maxsize=20_000)
def repaired(line: str, max_states: int | None = MAX_STATES) -> tuple[str, bool, bool]:
    """(the cheapest text reached from ``line``, whether ``line`` was wrongly decoded, whether the search came to its end).

    ``max_states``: states to expand at most; None searches until nothing is open.

    Signs that the line only mentions are no case. What replacement characters stand for is lost: such a line is a case
    even where nothing cheaper is reached.
    """
    mentions: list[str] = []

    def keep(m: re.Match) -> str:
        mentions.append(m.group())
        return f"\x02{len(mentions) - 1}\x03"

    start = _NAMED.sub(keep, _QUOTED.sub(keep, line))
    first = cost(start)
    best, best_cost = start, first
    # (cost, text, whether encodings were changed on the way)
    queue, seen, expanded, ended = [(first, start, False)], {hash(start)}, 0, False
    while queue and (max_states is None or expanded < max_states):
        here, text, recoded = heapq.heappop(queue)
        if recoded and here < best_cost:
            best, best_cost = text, here
        if here == 0 and recoded:
            ended = True
            break
        expanded += 1
        for changed, after in _edges(text):
            if hash(after) not in seen:
                seen.add(hash(after))
                heapq.heappush(queue, (cost(after), after, recoded or changed))
    garbled = first - best_cost >= MIN_GAIN
    if not garbled:
        best = start
    out = re.sub("\x02(\\d+)\x03", lambda m: mentions[int(m[1])], best)
    return out, garbled or LOST in start, ended or not queue


_SUSPECT = np.zeros(26, dtype=bool)
_SUSPECT[[HAN_RARE, HALF_KANA, BOPOMOFO, PRIVATE, CONTROL, REPLACED, BOX, KUN]] = True
_IS_EUROPEAN = np.zeros(26, dtype=bool)
_IS_EUROPEAN[list(_EUROPEAN)] = True
_IS_HAN = np.zeros(26, dtype=bool)
_IS_HAN[list(_HAN)] = True


def suspicious_lines(texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(index of a text, (start, end) of its lines that may be garbled), for texts with such lines."""
    chars, offsets = code_points(texts)
    c = _classes()[chars]
    odd = _SUSPECT[c]
    if len(c) > 1:
        odd[1:] |= (_IS_EUROPEAN[c[1:]] & _IS_EUROPEAN[c[:-1]]) | (_IS_HAN[c[1:]] & (c[:-1] == LOWER))
    at = np.flatnonzero(odd)
    doc = np.searchsorted(offsets, at, side="right") - 1
    for d in np.unique(doc):
        text, lines, done = texts[d], [], -1
        for p in (at[doc == d] - offsets[d]).tolist():
            if p >= done:
                start = text.rfind("\n", 0, p) + 1
                end = text.find("\n", p)
                done = len(text) if end < 0 else end
                lines.append((start, done))
        yield int(d), lines


def repair_values(df: DataFrame, id_column: str, text_column: str, max_states: int | None = MAX_STATES) -> DataFrame:
    """The values of a text column that were wrongly decoded, wholly or in part.

    Output: record_id, restored (the value with every garbled line at its cheapest reached text), complete (whether
    nothing of it is lost), searched (whether the search of every such line came to its end before ``max_states`` states;
    None sets no bound). Null and empty values are no cases; a repeated row comes out as often as it stands; other columns
    are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, out = column(batch, "record_id"), column(batch, "text"), []
            for first, run in chunks(texts):
                for d, lines in suspicious_lines(run):
                    text, parts, last, case, searched = run[d], [], 0, False, True
                    for start, end in lines:
                        good, garbled, ended = repaired(text[start:end], max_states)
                        case, searched = case or garbled, searched and (ended or not garbled)
                        parts += [text[last:start], good if garbled else text[start:end]]
                        last = end
                    if case:
                        whole = "".join([*parts, text[last:]])
                        out.append((ids[first + d], whole, LOST not in whole, searched))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.bool_(), pa.bool_()))], names=["record_id", "restored", "complete", "searched"]
            )

    values = df.select(F.col(id_column).cast("long").alias("record_id"), F.col(text_column).alias("text"))
    return spread(values.where("text is not null and record_id is not null")).mapInArrow(rows, "record_id long, restored string, complete boolean, searched boolean")
