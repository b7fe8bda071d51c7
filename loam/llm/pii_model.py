"""The model that tells personal data from what resembles it: boosted trees over proposed spans.

Labelled rows are made, not given: sentences of daily life, put together from small words in four languages, whose slots
are filled with random values of every type and with what resembles them (order and file numbers, amounts, dates,
versions, masked values, offices, places, courses). Nothing in them is taken from a corpus. Their number is bounded by
``LABELLED_TEXTS``. Spans are proposed by the same generators as for real texts, a span is positive where it is exactly a
filled slot of its type, and each type's threshold is calibrated on texts kept out of the fit. Names and the other types
have trees of their own. A fitted model can be saved and loaded.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from loam.llm.pii_spans import FEATURES, GIVEN_HAN, NAME, PLACE_PREPOSITIONS, SURNAMES, TYPES, capitalised, described

#: Labelled texts that the model is fitted and calibrated on; the bound of the sample.
LABELLED_TEXTS = 12000
TREES, DEPTH = 30, 5
#: Rows of features that are scored at a time: they stay in a core's cache.
ROWS = 2000

# --- fixed values: small words of which labelled sentences are made; a slot in braces is filled with a value of its kind
#: Per language: what stands before a name, what after it, and words of plain clauses (subjects, verbs, objects).
BEFORE_NAME = {
    "zh": ("姓名：", "作者：", "联系人：", "文：", "摄影：", "署名：", "邻居", "房东", "同事", "老板", "医生", "记者", "司机", "队长", "歌手", "读者", "村民", "画家", "家长", "店员", "学生", "由", "请", "和", "跟", "与", "找", "给", "向", "对", "被", "是", "叫", "见到", "送给", "听说", "据", "因", "{name}、", "{name}和", "{name}与", "", "", "昨天", "今早", "去年", "，", "。"),
    "en": ("met ", "saw ", "asked ", "told ", "thanked ", "with ", "from ", "for ", "by ", "to ", "near ", "like ", "and ", "is ", "was ", "called ", "named ", "ask ", "join ", "Dear ", "Hello ", "Yours, ", "By ", "From: ", "Name: ", "Photo: ", "Text: ", "Editor: ", "editor: ", "photo: ", "by: ", "name: ", "signed ", "Mr ", "Mrs ", "Dr ", "Ms ", "Prof ", "- ", "— ", "", "aunt ", "poet ", "nurse ", "that ", "of "),
    "de": ("traf ", "sah ", "fragte ", "mit ", "von ", "für ", "bei ", "an ", "und ", "ist ", "war ", "heißt ", "Herr ", "Frau ", "Herrn ", "Dr. ", "Liebe ", "Text: ", "Foto: ", "Name: ", "Autor: ", "foto: ", "gez. ", "i. A. ", "Ihr ", "", "— ", "auf ", "dass ", "durch ", "kam "),
    "fr": ("vu ", "avec ", "par ", "pour ", "chez ", "à ", "de ", "et ", "est ", "que ", "Mme ", "M. ", "Mlle ", "Cher ", "Texte : ", "Photo : ", "Nom : ", "Auteur : ", "nom : ", "photo : ", "Vu : ", "Lu : ", "", "— ", "appelle ", "invite ", "selon "),
}
AFTER_NAME = {
    "zh": ("说。", "说，", "在家。", "到了{place}。", "的手机是{phone}。", "写信：{email}。", "没来。", "，电话{phone}。", "（{phone}）", "、{name}都来了。", "先生来过。", "女士来过。", "老师不在。", "和{name}一起走。", "住{address}。", "，{address}。", "，{id}", "。", "（{id}）", "收，", "管这事。", "做饭，", "、{name}都在。", "和{name}。", "、{name}来信。", "等三人", "讲完，", "写的。", "（{address}）", "\n", "\n"),
    "en": (" said so.", " left early.", " lives in {place}.", " has cats.", " wrote it.", ", who sings, came.", " and {name} agreed.", " (born 1974)", " will be late.", " was away.", "'s boat", " on {phone}.", ", {phone}", " <{email}>", ", {address}.", " (ID {id})", ".", ", {id},", " or {email}.", "\n", "\n", " at noon.", ", it rains.", " sat down.", " and Mrs {name} sat.", " paid for {address}."),
    "de": (" sagt ja.", " kam spät.", " wohnt in {place}.", " hat Zeit.", ", {phone}.", " ({email})", ", {address}.", ", {id}", ".", " und {name} gingen.", " schrieb es.", "\n", "\n", ", der singt, kam.", " ist krank.", " liest {email}."),
    "fr": (" dit oui.", " est parti.", " vit à {place}.", " a le temps.", ", {phone}.", " ({email})", ", {address}.", ", {id}", ".", " et {name} sortent.", " écrit.", "\n", "\n", ", qui chante, vient.", " mange au {address}.", " ({id}) lit.", ", il pleut."),
}
CLAUSES = {
    "zh": (("天气", "火车", "学生", "音乐", "餐厅", "公园", "价格", "城市", "商店", "医院", "水果", "于是", "高温", "方言", "安静的", "白云", "金鱼", "石桥", "文具", "路灯", "车厢", "房顶", "管道", "常客", "马车", "成年", "时钟", "任性", "高楼", "关门", "解渴", "单车", "平原", "明天"), ("变了", "提前", "增多", "很好", "看见", "修好", "喜欢", "等待", "经过", "离开", "参加", "购买", "种下", "和谐", "向着", "给了", "从来", "应有", "对照"), ("一棵树", "三本画册", "旧家具", "高山茶", "温泉", "方桌", "老唱片", "成堆的柴", "金色麦子", "石榴", "白菜", "雨伞", "晚饭", "早班车", "河边", "万里", "高铁票", "包子", "牛奶", "江水", "茶叶", "马灯", "曲子", "谷子")),
    "en": (("The garden", "A storm", "My train", "Each spring", "Our cook", "Nobody", "It", "The {word} Garden", "The {course}", "Our {office}", "This", "Winter Tales", "Green Tea"), ("saw", "needs", "made", "took", "had", "sells", "likes", "gave", "holds", "starts"), ("two plums", "the piano", "old maps", "fresh bread", "a red kite", "no shoes", "the {course}", "the {word} {word} song", "a {word} {word} lamp", "some tea", "{office}", "Easter Monday", "the Blue Door cafe")),
    "de": (("Der Garten", "Ein Sturm", "Mein Zug", "Die Katze", "Niemand", "Das {course}", "Unser {office}", "Neue Bücher", "Frische Milch", "Im Winter"), ("sah", "braucht", "nahm", "hatte", "mag", "gab", "kauft"), ("zwei Äpfel", "das Klavier", "alte Karten", "Brot", "den roten Drachen", "keine Schuhe", "das {word} {word} Lied", "{office}", "Rote Grütze", "am Ostermontag")),
    "fr": (("Le jardin", "Un orage", "Mon train", "Le chat", "Personne", "Le {course}", "Notre {office}", "Nos voisins"), ("voit", "aime", "prit", "avait", "donne", "achète"), ("deux pommes", "le piano", "du pain", "la carte", "une lampe {word}", "la chanson {word} {word}", "{office}", "le Lundi Bleu")),
}
#: Fields, cells and lines with personal data, and sentences with what resembles it.
FIELDS = (
    "电话：{phone}", "手机号{phone}", "拨{phone}找人", "邮箱：{email}", "写信：{email}。", "地址：{address}", "家住{address}。", "寄：{address}", "快递送{address}，{name}", "请来{address}取", "到{address}找", "在{address}见", "去{address}。", "寄{address}，{name}收", "护照{id}", "身份证{id}", "证件 {id} 丢了", "| {name} | {phone} | {email} |", "| {name} | {id} |", "{name}：{phone}", "{name}，{id}", "[来信](mailto:{email})", "[电话](tel:{phone})", "{name}", "{phone}", "{id}", "{address}", "传真{phone}",
    "Phone {phone}", "Tel. {phone}", "Fax {phone}", "Ring {phone} now.", "or ring {phone}.", "E-mail {email}", "Mail {email} today.", "or {email}.", "He lives at {address}.", "Come to {address}.", "Home: {address}", "at {address} or on {phone}", "Pass no. {id}", "My ID is {id}.", "Tax no. {id}", "Card {id}", "Insured as {id}", "| {name} | {email} | {phone} |", "| {name} | {address} |", "[mail](mailto:{email})", "[ring](tel:{phone})", "{name} {phone}", "{name}, {address}",
    "Telefon {phone}", "Tel. {phone}", "Ruf {phone} an.", "Mail {email}", "oder {email}.", "Er wohnt {address}.", "Haus: {address}", "an {address}", "Ausweis {id}", "Ausweisnr. {id}", "Pass {id}", "Steuer {id}", "Kasse {id}", "| {name} | {phone} |", "Tél. {phone}", "au {phone}.", "Mail : {email}", "ou {email}.", "Il habite {address}.", "au {address}.", "Maison : {address}", "Passeport {id}", "Carte {id}", "Impôts {id}", "sécu {id}",
    "{phone} / {phone}", "{phone} {phone}", "{id} {phone}", "{phone}，{phone}", "**{phone}**", "{small} {phone}", "{date} {phone}", "{name} {phone} {phone}", "{id} / {phone}", "Tel: {phone} / {phone}",
)
OTHERS = (
    "单号{order}", "订单{order}。", "编号 {order}", "共{amount}元", "{small}页", "{date}，{time}", "版本{version}", "v{version} key@v{small}", "隐去：{masked}", "账号{order}", "书号{isbn}", "关注@{handle}", "{place}{office}", "| {office} | {small} |", "| {course} | {date} |", "{office}", "{course}", "{place}：{time}见", "| {word} | {place} |", "{word}", "{place}", "{place}第{small}号", "{office}和{office}", "{course}、{course}", "{word}、{word}", "见{word}（{small}）", "{place}的{word}",
    "Order {order}", "Ticket {order}.", "No. {order}", "{amount} in all", "{small} pages", "On {date} at {time}", "Build {version}", "key@v{small}", "hidden: {masked}", "Invoice {order}", "ISBN {isbn}", "See @{handle}.", "{office}", "{course}", "{hall}", "| {office} | {small} |", "| {course} | {date} |", "{place} map", "{office} and {office}", "{word} {word} notes", "The {word} Prize {small}", "the {word} {word} plan", "- {course}", "{course}: {small}", "{office}, {place}", "to {place} and {place}", "from {place}, {place}", "in {place}, {place}.", "seen from {place}, {place}", "near {place}, {place}", "at {place}, {place}", "to {place}, {place}", "in {place}, {place}", "aus {place}, {place}", "de {place}, {place}", "in {place} {noun} ist", "{place} {noun} und", "in {place} {noun} kaufen", "aus {place} {noun}.", "um {time} ein {noun}, {noun} da", "Alle {noun}, {place}", "{noun}, {place}", "{noun} {noun} – {place}", "{word} {word} Guide", "A {course} in {place}", "# {word} {word} manual", "room {small}, {office}", "The {office} and the {office}", "Under {word} {word} rules",
    "Auftrag {order}", "Vorgang {order}", "{amount} Euro", "{small} Seiten", "am {date}", "Das {course}", "{office}", "{office} und {office}", "Der {word}-Preis {small}", "Raum {small}, {office}", "Commande {order}", "Facture {order}.", "{amount} euros", "le {date}", "Le {course}", "{office}", "le {office} et le {office}", "Le prix {word} {small}", "salle {small}, {office}", "{order} {order}", "{amount} {amount} {small}", "{date} {order}", "{date}-{small}", "{time} {small} {small}",
)
ZH_PLACES, ZH_OFFICES = "清源安平宁和永丰长泰临江东阳南山西岭北川", ("邮局", "税务局", "医院", "中学", "博物馆", "车站", "派出所", "报社", "气象台", "社区中心", "体育馆", "住建局", "服务队")
EN_OFFICES = ("Post Office", "School Board", "Art Museum", "Health Centre", "Parks Department", "Fire Service", "Town Council", "Savings Bank", "Film Institute", "Housing Agency", "Rescue Group", "Weather Unit")
EN_COURSES = ("Cooking course", "Summer programme", "Rowing scheme", "Music project", "Safety exam", "Reading group", "Travel fund", "Design award", "Chess league")
DE_OFFICES, FR_OFFICES = ("Postamt", "Finanzamt", "Schulbehörde", "Sportverein", "Stadtmuseum", "Feuerwehr", "Wetterdienst", "Gesundheitszentrum", "Meldestelle"), ("Musée", "Hôpital", "Bureau de poste", "Lycée", "Comité des fêtes", "Caisse", "Service social")
ZH_WORDS = ("雨伞", "火车", "唱片", "茶叶", "报纸", "毛衣", "围巾", "方桌", "高铁", "高楼", "成语", "时钟", "白菜", "石榴", "路灯", "马车", "金鱼", "牛奶", "包子", "温泉", "车厢", "水泥", "江鱼", "钱包", "花盆", "毕业照", "计算器", "葡萄干", "邀请函", "说明书", "工资条", "报告单", "申请书", "发票联", "明信片", "同意书", "车票", "房租", "奖学金")
DE_NOUNS = ("Brot", "Milch", "Bücher", "Karten", "Möbel", "Zeitung", "Blumen", "Äpfel", "Fenster", "Wagen", "Lampen", "Kleider", "Schuhe", "Musik", "Wasser", "Hilfe", "Arbeit", "Wolle", "Pause", "Auskunft", "Rechte", "Regeln", "Stühle", "Zutritt", "Nachbarschaftshilfe", "Feuerwehrübung")
HALLS = ("Hall", "House", "College", "Court")
# ---------------------------------------------------------------------------------------------------------------------

_ONSET, _NUCLEUS, _CODA = "b br c d dr f g gl h j k l m n p r s st t th v w".split(), "a e i o u ai ea ou".split(), "n r l m s t nd rt ll ck lm".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_ONSET) + r.choice(_NUCLEUS) for _ in range(r.randint(1, 2))).capitalize() + r.choice(_CODA)


def _accented(r: random.Random, word: str) -> str:
    return word.replace("e", r.choice("éeè"), 1) if r.random() < 0.5 else word.replace("o", r.choice("oö"), 1)


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _wide(text: str) -> str:
    return text.translate({0x30 + i: 0xFF10 + i for i in range(10)})


def _han(r: random.Random, n: int, known: frozenset[str], part: float) -> str:
    """``n`` signs, each with probability ``part`` of ``known``, else any frequent one."""
    return "".join(r.choice(sorted(known)) if r.random() < part else chr(r.randint(0x4E00, 0x9FA5)) for _ in range(n))


def _usual(r: random.Random, known: int) -> str:
    """A part of a name: of every two, one is among ``known`` that are in many texts."""
    own = random.Random(r.randrange(known)) if r.random() < 0.5 else r
    return _accented(own, _word(own))


def _name(r: random.Random, han: bool, inverted: bool) -> str:
    if r.random() < 0.1:  # some persons are in many texts
        r = random.Random(r.randrange(15))
    if han:
        # of some family names only the place in the sentence tells
        return _han(r, 1, SURNAMES, 0.9) + r.choice(("",) * 8 + ("　", "·")) + _han(r, r.choice((1, 2, 2)), GIVEN_HAN, 0.55)
    first, last = _usual(r, 60), _usual(r, 250)
    if r.random() < 0.15:
        last += "-" + _word(r)
    if r.random() < 0.15:
        last = last.upper()
    form = r.random()
    if form < 0.12:
        return f"{last}, {first}" if inverted else f"{first} {last}"
    if form < 0.24:
        return f"{first[0]}. {last}"
    return f"{first} {chr(r.randint(65, 90))}. {last}" if form < 0.34 else f"{first} {last}"


def _phone(r: random.Random, lang: str) -> str:
    if lang == "zh":
        mobile = "1" + r.choice("3456789") + _digits(r, 9)
        out = r.choice((mobile, mobile[:3] + "-" + mobile[3:7] + "-" + mobile[7:], mobile[:3] + " " + mobile[3:7] + " " + mobile[7:], "+86 " + mobile[:3] + "-" + mobile[3:7] + "-" + mobile[7:], "0086" + mobile,
                        _wide(mobile), "0" + _digits(r, 3) + "-" + _digits(r, 7), "（0" + _digits(r, 3) + "）" + _digits(r, 7), "0" + _digits(r, 2) + "-" + _digits(r, 8), "400-" + _digits(r, 3) + "-" + _digits(r, 4)))
        return out + ("转" + _digits(r, 3) if "0" == out[0] and "-" in out and r.random() < 0.5 else "")
    a, b, c = r.choice("23456789") + _digits(r, 2), _digits(r, 3), _digits(r, 4)
    if lang == "en":
        out = r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 {a} {b} {c}", f"+1 {a}-{b}-{c}", f"020 {_digits(r, 4)} {c}", f"+44 7{_digits(r, 3)} {_digits(r, 6)}", f"0{_digits(r, 4)} {_digits(r, 6)}", f"+44 20 {_digits(r, 4)} {c}"))
        return out + (f" ext. {_digits(r, 2)}" if r.random() < 0.15 else "")
    if lang == "de":
        return r.choice((f"+49 (0){_digits(r, 2)} {_digits(r, 5)}-{_digits(r, 3)}", f"0{_digits(r, 3)}/{_digits(r, 8)}", f"0{_digits(r, 2)} {_digits(r, 5)} {_digits(r, 3)}", f"+49 {_digits(r, 3)} {_digits(r, 7)}", f"0{_digits(r, 3)} {_digits(r, 7)}", f"(0{_digits(r, 3)}) {_digits(r, 6)}"))
    pairs = [_digits(r, 2) for _ in range(4)]
    d = r.choice("123456789")
    return r.choice((f"0{d} " + " ".join(pairs), f"0{d}." + ".".join(pairs), f"0{d}" + "".join(pairs), f"+33 {d} " + " ".join(pairs), f"+33 (0){d} " + " ".join(pairs), f"0{d}-" + "-".join(pairs)))


def _id(r: random.Random, lang: str) -> str:
    y, m, d = r.randint(1940, 2008), r.randint(1, 12), r.randint(1, 28)
    if lang == "zh":
        parts = (str(r.randint(1, 9)) + _digits(r, 5), f"{y}{m:02}{d:02}", _digits(r, 3) + r.choice("0123456789Xx"))
        return r.choice(("".join(parts), "".join(parts), " ".join(parts), _wide("".join(parts)), r.choice("EGPD") + r.choice(("", "Z", "A")) + _digits(r, 7)))
    up = lambda: chr(r.randint(65, 90))
    if lang == "en":
        n = _digits(r, 6)
        return r.choice((f"{up()}{up()}{n}{up()}", f"{up()}{up()} {n[:2]} {n[2:4]} {n[4:]} {up()}", f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}", f"{_digits(r, 3)} {_digits(r, 2)} {_digits(r, 4)}", f"{up()}{up()}{_digits(r, 7)}"))
    if lang == "de":
        return r.choice((f"{_digits(r, 8)}{up()}{_digits(r, 3)}", f"{_digits(r, 2)} {_digits(r, 3)} {_digits(r, 3)} {_digits(r, 3)}", f"{up()}{up()}{_digits(r, 7)}", f"{_digits(r, 2)} {_digits(r, 6)} {up()} {_digits(r, 3)}", _digits(r, 11), f"{_digits(r, 2)}/{_digits(r, 3)}/{_digits(r, 5)}"))
    s = r.choice("12")
    return r.choice((f"{s} {y % 100:02} {m:02} {_digits(r, 2)} {_digits(r, 3)} {_digits(r, 3)} {_digits(r, 2)}", f"{s}{y % 100:02}{m:02}{_digits(r, 10)}", f"{_digits(r, 2)}{up()}{up()}{_digits(r, 5)}", f"{up()}{up()}{_digits(r, 7)}"))


def _address(r: random.Random, lang: str) -> str:
    n = r.randint(1, 260)
    if lang == "zh":
        han = lambda k: "".join(chr(r.randint(0x4E00, 0x9FA5)) if r.random() < 0.5 else r.choice(ZH_PLACES) for _ in range(k))
        tail = r.choice((f"{n}号", f"{n}-{r.randint(1, 9)}号", f"{n}弄{r.randint(1, 60)}号", f"{n}号{r.randint(1, 9)}幢{r.randint(101, 999)}室", f"{n}号{r.randint(1, 9)}栋{r.randint(1, 4)}单元{r.randint(101, 999)}室"))
        towns = han(2) + r.choice("市县区")
        if r.random() < 0.2:
            towns = han(2) + "市" + han(2) + r.choice("区县")
        return towns + han(2) + r.choice(("路", "街", "巷", "大道", "里")) + tail
    a, town = _word(r), _word(r)
    if lang == "en":
        street = f"{n}{r.choice(('', '', '', 'A', 'B'))}{r.choice((' ', ' ', ', '))}{a} {r.choice(('Street', 'St.', 'Road', 'Rd', 'Lane', 'Avenue', 'Crescent', 'Close', 'Yard', 'Grove'))}"
        if r.random() < 0.3:
            street = f"{r.choice(('Flat', 'Unit', 'Apt'))} {r.randint(1, 90)}, " + (street if r.random() < 0.5 else street.lstrip("0123456789AB, "))
        return street + f", {town}" + (f" {chr(r.randint(65, 90))}{chr(r.randint(65, 90))}{r.randint(1, 9)} {r.randint(1, 9)}{chr(r.randint(65, 90))}{chr(r.randint(65, 90))}" if r.random() < 0.4 else "")
    code = _digits(r, 5)
    if lang == "de":
        street = r.choice((f"{a}er {r.choice(('Weg', 'Platz', 'Straße', 'Allee'))}", f"{a}{r.choice(('straße', 'weg', 'gasse', 'platz'))}"))
        return f"{street} {n}{r.choice(('', '', 'a', ' b'))}, {code} {town}"
    return f"{n}{r.choice(('', '', ' bis', ' ter'))}{r.choice((', ', ' '))}{r.choice(('rue', 'avenue', 'chemin', 'quai', 'boulevard'))} {r.choice(('de la', 'des', 'du'))} {a}, {code} {_accented(r, town)}"


def _email(r: random.Random) -> str:
    local = _word(r).lower() + r.choice(("", ".", "_", "-")) + _word(r).lower() + r.choice(("", _digits(r, 2), "+" + _digits(r, 2)))
    host, tld = f"{_word(r).lower()}-{_word(r).lower()[:4]}", r.choice(("example", "test", "edu.example", "invalid", "org", "com"))
    form = r.random()
    if form < 0.1:
        return f"{local} [at] {host} [dot] " + tld.replace(".", " [dot] ")
    if form < 0.15:
        return f"{local} AT {host} DOT {tld}"
    return local + r.choice(("@", "@", "@", "@", "＠", "(at)", " @ ", "#", " at ")) + f"{host}.{tld}" if form < 0.9 else f"{local}@{host}.{tld}".upper()


def _resembling(kind: str, r: random.Random, lang: str) -> str:
    """A value that is no personal data."""
    place = "".join(r.sample(ZH_PLACES, 2)) + r.choice("市县区") if lang == "zh" else _word(r) + r.choice(("by", "ton", "ford"))
    y, m, d = r.randint(2015, 2026), r.randint(1, 12), r.randint(1, 28)
    return {
        "order": lambda: r.choice(("2024" + _digits(r, 14), "77" + _digits(r, 9), "2023" + _digits(r, 8), _digits(r, 10))),
        "amount": lambda: str(r.randint(100, 9_999_999)),
        "small": lambda: str(r.randint(1, 999)),
        "date": lambda: r.choice((f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{y}年{m}月{d}日", f"{d:02}/{m:02}/{y}")),
        "time": lambda: f"{r.randint(7, 18)}:{r.randint(10, 59)}",
        "version": lambda: f"{r.randint(1, 20)}.{r.randint(0, 50)}.{r.randint(0, 9)}.{r.randint(100, 999)}",
        "masked": lambda: r.choice((f"142****{_digits(r, 4)}", f"***-**-{_digits(r, 4)}", f"06 ** ** ** {_digits(r, 2)}", f"********{_digits(r, 4)}")),
        "isbn": lambda: f"978-{_digits(r, 1)}-{_digits(r, 4)}-{_digits(r, 4)}-{_digits(r, 1)}",
        "handle": lambda: _word(r).lower(),
        "hall": lambda: f"{_word(r)} {r.choice(HALLS)}",
        "noun": lambda: r.choice(DE_NOUNS),
        "surname": lambda: _word(r),
        "place": lambda: place,
        "office": lambda: place + r.choice(ZH_OFFICES) if lang == "zh" else {"en": f"{place} {r.choice(EN_OFFICES)}", "de": f"{r.choice(DE_OFFICES)} {place}", "fr": f"{r.choice(FR_OFFICES)} de {place}"}[lang],
        "course": lambda: _han(r, 2, GIVEN_HAN, 0.6) + r.choice(("比赛", "课程", "项目", "培训班", "活动")) if lang == "zh" else f"{_word(r)} {r.choice(EN_COURSES)}",
        "word": lambda: (r.choice(ZH_WORDS) if r.random() < 0.6 else _han(r, r.choice((2, 2, 3)), SURNAMES, 0.3)) if lang == "zh" else _word(r),
    }[kind]()


def _clause(r: random.Random, lang: str) -> str:
    """A plain clause without personal data."""
    words = [r.choice(x) for x in CLAUSES[lang]]
    return "".join(words) + r.choice("，。") if lang == "zh" else " ".join(words) + r.choice((". ", ". ", ", "))


def _sentence(r: random.Random, lang: str) -> str:
    """A sentence with open slots."""
    form = r.random()
    if form < 0.45:
        before, after = r.choice(BEFORE_NAME[lang]), r.choice(AFTER_NAME[lang])
        lead = "" if not before or before[:1].isupper() or before[-1:] in "：。" or before in ("- ", "— ") else _clause(r, lang) if r.random() < 0.5 else r.choice(CLAUSES[lang][0]) + ("" if lang == "zh" else " ")
        # a family name stands first in lists, fields and bylines, not after a preposition of place
        slot = "{plain}" if before.strip() in PLACE_PREPOSITIONS else "{name}"
        return lead + before + slot + after + (("" if lang == "zh" else " ") + _clause(r, lang) if r.random() < 0.3 and after[-1:] in "。，." else "")
    if form < 0.65:
        return r.choice(FIELDS)
    if form < 0.85:
        return r.choice(OTHERS)
    clauses = _clause(r, lang) + _clause(r, lang)
    return _SLOT.sub("", clauses).upper() if form > 0.96 else clauses


def labelled_text(seed: int) -> tuple[str, set[tuple[int, int, int]]]:
    """A text of a few made sentences and its personal data as (type, start, end)."""
    r = random.Random(seed)
    lang = r.choice(("zh", "zh", "en", "de", "fr"))
    text, gold = "", set()
    for _ in range(r.randint(1, 4)):
        if text:
            text += r.choice(("\n", "\n", "\n\n", "" if text[-1] in "。，" else " "))
        sentence = _sentence(r, lang)
        own = "zh" if any("一" <= c <= "鿿" for c in sentence) else "en" if lang == "zh" and any(c.isalpha() for c in _SLOT.sub("", sentence)) else lang
        parts = _SLOT.split(sentence)
        while len(parts) > 1:
            text += parts[0]
            slot = parts[1]
            kind = {"email": 0, "phone": 1, "id": 2, "address": 3, "name": 4, "plain": 4}.get(slot)
            makers = (lambda: _email(r), lambda: _phone(r, own), lambda: _id(r, own), lambda: _address(r, own), lambda: _name(r, own == "zh", slot == "name"))
            value = _resembling(slot, r, own) if kind is None else makers[kind]()
            if kind is not None:
                gold.add((kind, len(text), len(text) + len(value)))
            text += value
            parts = parts[2:]
        text += parts[0]
    return text, gold


_SLOT = re.compile(r"\{(\w+)\}")


#: Pairs of Han signs and capitalised words count as frequent from this part of the texts on; so there are at most 1 / FREQUENT times as many of
#: them as a mean text has different ones, whatever the number of texts. PRIOR texts without any are added.
FREQUENT, PRIOR = 0.004, 1000
_PAIR = re.compile("(?=([一-鿿]{2}))")


def pairs_of(text: str) -> set[str]:
    """The different pairs of neighbouring Han signs of a text."""
    return set(_PAIR.findall(text))


def shares(counts: Mapping[str, int], texts: int) -> dict[str, float]:
    """The frequent pairs and words and the per cent of the texts that hold them, 1 at most: more says no more."""
    return {pair: min(1.0, 100 * n / (texts + PRIOR)) for pair, n in counts.items() if n >= FREQUENT * (texts + PRIOR)}


class Trees(NamedTuple):
    """Boosted trees as arrays, tree by tree. A node is a leaf where its feature is -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability that each row of features is personal data."""
        margin = np.zeros(len(x))
        feature, children = np.maximum(self.feature, 0), np.stack([self.left, self.right], axis=1).ravel()  # a leaf's children are itself
        for start in range(0, len(x), ROWS):
            own = np.ascontiguousarray(x[start : start + ROWS])
            flat, row = own.ravel(), np.arange(len(own)) * own.shape[1]
            for root in self.roots:
                node = np.full(len(own), root)
                for _ in range(DEPTH):
                    right = flat.take(row + feature.take(node)) > self.threshold.take(node)
                    node = children.take(2 * node + right)
                margin[start : start + ROWS] += self.value.take(node)
        return 1 / (1 + np.exp(-2 * margin))


class SpanModel(NamedTuple):
    """The trees of names, those of the other types, and each type's threshold."""

    names: Trees
    others: Trees
    cut: tuple[float, ...]

    def score(self, x: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for trees, own in ((self.names, kinds == NAME), (self.others, kinds != NAME)):
            if own.any():
                out[own] = trees.score(x[own])
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the model as one row of JSON to ``path`` (any file system that Spark writes to)."""
        parts = {"cut": self.cut, "names": [a.tolist() for a in self.names], "others": [a.tolist() for a in self.others]}
        spark.createDataFrame([(json.dumps(parts),)], "model string").coalesce(1).write.text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SpanModel:
        parts = json.loads(spark.read.text(path, wholetext=True).first()[0])
        trees = (Trees(*(np.array(a, dtype=float if k in (1, 4) else int) for k, a in enumerate(parts[name]))) for name in ("names", "others"))
        return cls(*trees, tuple(parts["cut"]))


def _flat(model) -> Trees:
    """A fitted model's trees as arrays."""
    nodes, roots = [], []

    def add(node, weight: float) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, at, at, node.prediction() * weight])
        if node.subtreeDepth():
            split = node.split()
            nodes[at][:2] = [split.featureIndex(), split.threshold()]
            nodes[at][2] = add(node.leftChild(), weight)
            nodes[at][3] = add(node.rightChild(), weight)
        return at

    for tree, weight in zip(model.trees, model.treeWeights):
        roots.append(add(tree._java_obj.rootNode(), weight))
    parts = np.array(nodes, dtype=float).T
    return Trees(parts[0].astype(int), parts[1], parts[2].astype(int), parts[3].astype(int), parts[4], np.array(roots))


_fitted: dict[tuple[int, int], SpanModel] = {}


def fitted(spark: SparkSession, texts: int = LABELLED_TEXTS, seed: int = 7) -> SpanModel:
    """The model fitted on ``texts`` labelled texts, a quarter of them kept out to calibrate the thresholds.

    It depends on the two arguments alone and is fitted once a process for each pair of them; ``SpanModel.save`` keeps it
    for other processes.
    """
    if (texts, seed) in _fitted:
        return _fitted[texts, seed]
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            made = [labelled_text(seed * 1_000_003 + int(i)) for i in ids]
            texts = [text for text, _ in made]
            doc, proposed, x = described(texts, frequent)
            x = np.where((ids[doc] % 5 == 1)[:, None], described(texts, {})[2], x)  # as in tables too small for any part to be frequent
            label = [float(tuple(s) in made[i][1]) for i, s in zip(doc.tolist(), proposed.tolist())]
            yield pd.DataFrame({"held": ids[doc] % 4 == 0, "label": label, "kind": proposed[:, 0], "x": list(x)})

    # parts of all labelled texts, as they are counted for a corpus
    made = (labelled_text(seed * 1_000_003 + i)[0] for i in range(texts))
    counts = Counter(part for text in made for part in pairs_of(text) | capitalised(text))
    frequent = shares(counts, texts)
    table = spark.range(0, texts, 1, 4).mapInPandas(rows, "held boolean, label double, kind int, x array<double>").persist()
    data = table.where("not held").select("kind", "label", array_to_vector("x").alias("features"))
    booster = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=32, seed=seed, cacheNodeIds=False)
    trees = [_flat(booster.fit(data.where(f"kind {sign} {NAME}"))) for sign in ("=", "<>")]
    held = table.where("held").select("label", "kind", "x").toPandas()  # a quarter of the bounded sample
    table.unpersist()
    model = SpanModel(*trees, (0.5,) * len(TYPES))
    p, cuts = model.score(np.array(held["x"].tolist()).reshape(-1, FEATURES), held["kind"].to_numpy()), []
    for k in range(len(TYPES)):
        own = (held["kind"] == k).to_numpy()
        true, score = held["label"].to_numpy()[own] > 0, p[own]
        grid = np.arange(0.2, 0.65, 0.05)
        f1 = [2 * (true & (score >= t)).sum() / max(1, true.sum() + (score >= t).sum()) for t in grid]
        cuts.append(float(np.quantile(grid[np.isclose(f1, max(f1), atol=0.002)], 0.25)))
    _fitted[texts, seed] = model._replace(cut=tuple(cuts))
    return _fitted[texts, seed]
