"""Wrongly decoded text: exact round trips through wrong decodings, and text that only looks garbled."""

from __future__ import annotations

import pytest

from loam.llm import encoding_repair as E

TEXTS = ["Résumé – the café’s “naïve” menu", "关于青杉评鉴计划集中核对信息的通知", "Übergröße für Prüfungsämter", "第36批名单（公示）：报名系统"]


def misread(text, true, wrong):
    raw = text.encode(true)
    return "".join(chr(b) if wrong == "cp1252" and b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes((b,)).decode(wrong) for b in raw)


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("wrong", ["cp1252", "mac_roman"])
def test_utf8_read_as_one_byte(text, wrong):
    assert E.repaired(misread(text, "utf-8", wrong))[:2] == (text, True)


@pytest.mark.parametrize("text", TEXTS)
def test_twice_misread(text):
    assert E.repaired(misread(misread(text, "utf-8", "cp1252"), "utf-8", "cp1252"))[:2] == (text, True)


@pytest.mark.parametrize("text", [TEXTS[1], TEXTS[3]])
@pytest.mark.parametrize(("true", "wrong"), [("gbk", "latin-1"), ("gbk", "big5hkscs"), ("utf-8", "gb18030"), ("utf-8", "cp932")])
def test_chinese_read_as_something_else(text, true, wrong):
    try:
        bad = text.encode(true).decode(wrong, "replace")
    except UnicodeError:
        pytest.skip("cannot be misread so")
    good, garbled, _ = E.repaired(bad)
    assert garbled and (good == text or "�" in bad)


@pytest.mark.parametrize(
    "text",
    [*TEXTS, "", "plain", "Why “Ã©” shows up in old previews", "预览若出现“锟斤拷”一类符号", "Price marks: ¥, £, €, ¢ and ¤ are kept", "ÉTAT DU RÉSEAU À ÂNCOURT – N° 7", "What the sign � means",
     "zeigt Â, Ã und Ä nebeneinander", "見本ﾌｫﾙﾀﾞの半角ｶﾅ", "繁體附註：臺灣堃鑫範例檔", "Пример текста № 4", "l’été « là »", "原件𠀋窗口", "👍🏽 fine"],
)
def test_rightly_decoded_text_stays(text):
    assert E.repaired(text)[:2] == (text, False)


def test_part_of_a_line_and_escapes():
    assert E.repaired("名单 caf" + misread("é", "utf-8", "cp1252") + " 公示")[:2] == ("名单 café 公示", True)
    assert E.repaired("plain &amp; simple")[1] is False


def test_columns(spark):
    bad = misread(TEXTS[0], "utf-8", "cp1252")
    long = "fine line\n" * 20_000 + bad
    rows = [(1, bad, "x"), (1, bad, "x"), (2, None, "x"), (3, "", "x"), (4, TEXTS[0], "x"), (5, long, "x"), (6, "lost � here", "x"), (None, bad, "x")]
    df = spark.createDataFrame(rows, "id long, body string, record_id string")
    out = {x.record_id: (x.restored, x.complete) for x in E.repair_values(df, "id", "body").collect()}
    assert out == {1: (TEXTS[0], True), 5: (long.replace(bad, TEXTS[0]), True), 6: ("lost � here", False)}
    assert {x.record_id for x in E.repair_values(df, "id", "body").collect()} == {1, 5, 6}
    assert E.repair_values(df.where("false"), "id", "body").count() == 0


def test_cut_searches_are_reported(spark):
    bad = misread("Größe und Maß für Übungen", "utf-8", "cp1252")
    assert E.repaired(bad)[2] and not E.repaired(bad, 1)[2]
    assert E.repaired(bad, None) == E.repaired(bad)
    df = spark.createDataFrame([(1, bad), (2, "plain")], "id long, body string")
    assert [x.searched for x in E.repair_values(df, "id", "body").collect()] == [True]
    assert not any(x.searched for x in E.repair_values(df, "id", "body", max_states=1).collect())
