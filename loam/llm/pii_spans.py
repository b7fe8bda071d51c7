"""Spans that may be personal data: high-recall generators, and what each span looks like.

A generator proposes overlapping spans of one type; ``features`` describes a span by its format and by what stands around
it. Which spans are personal data is decided elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from functools import cache, lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np

from loam.llm.textbytes import code_points

TYPES = ("email", "phone", "id_number", "address", "person_name")
EMAIL, PHONE, ID_NUMBER, ADDRESS, NAME = range(5)


class Span(NamedTuple):
    kind: int
    start: int
    end: int


# --- fixed values: words of daily language around personal data, closed word classes, and family names ----------------
PHONE_WORDS = r"电话|手机|热线|拨打|致电|传真|座机|来电|\b[Tt]el\b|T[ée]l\b|[Tt]elefon|[Pp]hone|[Mm]obile|\b[Cc]all\b|\b[Rr]ing\b|\bHandy\b|\b[Ff]ax\b|[Aa]ppel|\b[Rr]uf"
ID_WORDS = r"身份证|证件|护照|社保|税号|\bID\b|[Pp]assport|[Ii]dentit|[Ss]ocial|[Ii]nsurance|\b[Tt]ax\b|[Aa]usweis|[Rr]eisepass|[Ss]teuer|[Ss]ozialvers|s[ée]curit[ée]|[Pp]asseport|fiscal|\bcard\b"
MAIL_WORDS = r"邮箱|邮件|mailto|[Mm]ail|[Cc]ourriel|\b[Ww]rite\b|[ÉEé]cri|schreib"
ADDRESS_WORDS = r"地址|住|寄|搬|[Aa]nschrift|[Aa]dress|wohn|\bliv(?:e|es|ed|ing)\b|[Vv]isit|demeur|domicil|habite|\bto\b|\bat\b|\bau\b|\ban\b|\bin\b"
NUMBER_WORDS = r"流水|订单|编号|文号|金额|单号|版本|合同|账号|共计|[Oo]rder|[Tt]icket|[Dd]ossier|[Vv]organg|ISBN|ISSN|[Vv]ersion|[Bb]uild|[Ii]nvoice|[Rr]echnung|[Ff]acture|[Ss]erial|\b[Nn]o\.|€|¥|\$|£|[Pp]age|[Mm]ask|[Cc]osts?\b|[Pp]rice|[Pp]reis|[Pp]rix"
NAME_WORDS = r"姓名|联系人|负责人|作者|编辑|署名|名叫|[人者员师长生]|[Nn]ame|[Aa]ut(?:h?or|eur)|[Ee]dit(?:or|ed)|[Rr]eport(?:er)?|[Ss]ign[ée]|[Cc]ontact|[Ff]rom|[Dd]ear|[Vv]on|[Dd]e|[Pp]ar|[Bb]y|gez\.?|[Rr]edak\w+|—|–"
NUMBER_AFTER = r"^\s?(?:元|页|份|名|人|册|件|次|pages?\b|Seiten|EUR|euros?|€|pieces|kg|km|%)"
ORGANISATION = r"\b(?:Office|Board|Centre|Center|Desk|Unit|Service|Services|Library|Hall|Prize|Preis|Award|Prix|Institute|University|School|College|Council|Agency|Department|Committee|Examination|Programme|Program|Project|Course|Scheme|Archive|Archives|Museum|Bank|Group|Company|Limited|Ltd|Inc|GmbH|Street|Road|Lane|Avenue|Stiftung|Stelle|Amt|Verband|Verein|Bureau|Guichet|Pôle|Régie|Fondation|Société|Ministère|Mairie|Institut|Universität|Hochschule|Schule)\b|\w(?:amt|stelle|büro|verband|archiv|schule|haus|werk|dienst|zentrum|kurs|programm|prüfung|preis)\b"
TITLES = r"(?:Dr|Ms|Mrs|Mr|Prof|Mme|Mlle|M|Herrn?|Frau|Madame|Monsieur)\.?"
#: Words written with a capital at the head of sentences and lines; no person is called by them.
STARTERS = frozenset("No Nobody Nothing Once Whenever If Because Between Keine Kein Keinen Keiner Zwischen Sobald Während Jede Jeder Jedes Alle Aucun Aucune Chaque Quelque Toute Tout Entre Lorsque The A An In On At By For From To Of And Or But As If When While Under After Before With Without Until Since This That These Those It We You He She They My Our Your His Her Their Not No Yes Is Are Was Were Has Have Had All Each Every Some Any Please Dear How What Why Who Where See Note Der Die Das Den Dem Des Ein Eine Einen Einem Einer Im Am Zum Zur Bei Beim Mit Von Vom Nach Vor Für Und Oder Aber Auf Aus Wenn Als Ist Sind War Hat Wir Sie Er Es Ich Wie Was Wer Wo Bis Ab Nur Auch Laut Seit Le La Les Un Une Des Du De Au Aux Dans Par Pour Sur Sous Avec Sans Et Ou Mais Si Quand En Ce Cette Ces Il Elle On Nous Vous Ils Est Sont Dès Selon Après Avant Comment Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December".split())
DETERMINERS = frozenset("the a an this that each every our your its der die das den dem des ein eine einen einem einer dieser diese le la les un une du des au aux ce cette".split())
PREPOSITIONS = frozenset("by of for from to with at in on under after before near via through about than von vom mit für bei an auf aus nach über unter zu gegen par pour de avec chez à sur dans sous selon".split())
#: Prepositions before places rather than persons.
PLACE_PREPOSITIONS = frozenset("in at from to near into across nach aus bei ab in im à en vers depuis".split())
CONJUNCTIONS = frozenset("and or & und oder sowie et ou".split())
#: Signs of Chinese that stand next to a name rather than inside a word, before and after it.
BEFORE_HAN = "人者员师长生父母妻夫儿女友弟兄姐妹叔伯舅姨爷奶哥嫂孩据经由被请让给对向找问见与和跟同叫是为即有把托送陪谢及或因到天年月日午晚后前时了说着的授记任家户方位名叫致以从像等而但又也还就都只并上下里外中间在选举机手工兵警官导匠商农帮派聘招邀约访告谢看教老小"
AFTER_HAN = "先女老同教博主经院医律法工记说在到于的是表介住电负出来去认参任获收因等已将为今从向也并还和与及或两三个这那曾正把被对给就都才不没要会能可想问答写打带拿买做看听走跑开回进上下家夫妻父母身手联签署完提办接承申请报领递交通告指强补称之其"
#: Family names, frequent ones first.
SURNAMES = frozenset(
    "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
    "庞樊兰殷施陶洪翟安颜倪严牛温芦季俞章鲁葛伍韦申尤毕聂焦向柳邢路岳齐梅莫庄辛管祝左涂谷祁时舒耿牟卜詹关苗凌费纪靳盛童欧甄项曲成游阳裴席卫查屈鲍位覃霍翁隋植甘景薄单包司柏宁柯阮桂闵解强柴华车冉房边辜吉饶刁瞿戚丘"
    "桑闻岑卓符蒲鄢郗逄亓郁蔺臧娄敖褚伏狄宫巫滕沙晏冷邬匡仲迟郎褟燕佘诸戎羊阚连普皮薛仇祖晋浦姬隆储巩嵇蒙米鞠"
)
#: Characters that given names are mostly made of.
GIVEN_HAN = frozenset("明华建国文军平志伟东海强晓生光林玉兰芳秀英丽敏静雅洁慧婷雪梅云霞思远子涵宇轩浩然俊杰勇磊刚超峰亮毅鹏飞辉波斌涛凯翔晨阳旭佳欣怡琳瑶璐蕾薇萍红燕娟娜艳莉莹倩颖悦彤诗梦若雨可心安宁德荣福贵祥春夏秋冬月星天一小大永振家庭昌盛兴旺成龙虎彪山川河江湖溪泉石松柏竹菊荷莲桂芝芸蓉蕙禾苗言泽润清书墨琴淑贤惠贞仪敬恩义礼智信忠孝")
#: Last characters of words for documents, fees, bodies and places rather than of given names.
OBJECT_ENDS = "函单书表证票件费法规则会组员区市县局处科室馆院部所页份稿据款项目录题卷号码率量值线路站台网店厂校系统式性力度期间时日月年段节课程段型类级层"
#: Frequent words that begin with a sign which is also a family name, and words that stand alone in lines and cells.
COMMON_WORDS = frozenset(
    "于是 于此 关于 关系 关闭 关注 关键 高度 高等 高中 高级 高校 高考 方式 方法 方面 方案 方便 方向 成立 成绩 成员 成为 成功 成果 成本 程序 程度 任务 任何 任意 任期 时间 时候 时期 时长 时段 安排 安全 安装 安静 白天 白色 万元 向上 何时 何人 解决 解释 解答 解除 单位 单独 单次 单程 金额 金融 常见 常用 常年 查询 查看 查验 查收 段落 毛病 史料 强调 强制 强化 "
    "温度 华丽 车站 车辆 房间 房屋 边界 文件 文章 文字 文化 文号 文档 石头 钟头 路线 路口 章节 项目 纪律 纪念 盛大 童年 曲线 游客 游戏 席位 卫生 位置 位于 景点 包括 包含 司机 华北 管理 管辖 左右 左边 谷物 祝贺 季度 申请 申报 申诉 莫名 辛苦 齐全 康复 江河 顾客 马上 马路 林业 和谐 许可 许多 余额 余下 田野 方才 石油 金属 白纸 水平 明确 符合 符号 连接 连续 普通 普遍 米饭 沙发 冷却 宫殿 祖国 储存 燕子 蒲公 闻名 "
    "比对 介绍 核验 审议 统计 了解 批准 研究 同意 校验 规定 本人 经理 费用 情况 材料 数据 信息 电话 手机 证件 地址 邮箱 日期 单位 名称 备注 合计 姓名 性别 编号 目录 附件 说明 通知 首页 简介 正文 摘要 结论 联系 负责 署名 摄影 流程 要求 须知 步骤 公告 结果 标题 内容 来源 作者 编辑".split()
)
STREET_EN = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Crescent|Cres|Close|Drive|Dr|Court|Ct|Place|Pl|Square|Sq|Terrace|Way|Hill|Row|Gardens|Boulevard|Blvd|Walk|Mews|Parade|Green|Yard|Quay|Wharf|Grove|Park|View|Rise|Vale|Circus|Circle|Highway|Parkway|Alley|Gate|Croft|Esplanade|Promenade)\b\.?"
STREET_FR = r"(?:rue|avenue|av\.|boulevard|bd|chemin|quai|place|impasse|all[ée]e|cours|route|square|passage|sentier|venelle)"
STREET_DE = r"(?:(?:[Ss]tra(?:ß|ss)e|[Ss]tr\.|[Ww]eg|[Pp]latz|[Aa]llee|[Gg]asse|[Rr]ing|[Uu]fer|[Dd]amm|[Mm]arkt|[Ss]teig|[Cc]haussee))"
# ---------------------------------------------------------------------------------------------------------------------

_D = "[0-9０-９]"
_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zà-öø-ÿß"
_HAN = "[一-鿿]"
_AT = re.compile(r"\s?[@＠#＃]\s?|\s?[(\[{（【]\s?(?:at|AT|@|a|arobase|艾特)\s?[)\]}）】]\s?|\s(?:AT|at|arobase|艾特)\s(?=[A-Za-z0-9-]+(?:\.|．|\s?[(\[{]|\s(?:dot|DOT|punkt|point)\s))")
_LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*$")
_DOT = r"(?:[.．]|\s?[(\[{（]\s?(?:dot|DOT|punkt|point|点)\s?[)\]}）]\s?|\s(?:dot|DOT|punkt|point)\s)"
_HOST = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,14}}(?![A-Za-z0-9@-])")
_EXTENSION = re.compile(r"\s?(?:转|分机|ext\.?|x|Durchwahl|App\.?|poste|-)\s?[0-9０-９]{1,5}(?![0-9])", re.IGNORECASE)
_CODE = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{1,3} ?[0-9]{2}(?:[ -]?[0-9]{1,8}){1,4}(?: ?[A-Z])?|[0-9]{5,17}[A-Z][0-9]{0,4}|[0-9]{6} [0-9]{8} [0-9]{3}[0-9Xx]|[0-9]{17}[Xx]|[0-9]{2} [0-9]{6} [A-Z] [0-9]{3}|[0-9]{2}[A-Z]{2}[0-9]{5}|[A-Z]{1,2}[0-9]{6,9}|[A-Z][A-Z0-9]{8,10})(?![A-Za-z0-9])")
_WIDE_CODE = re.compile(r"[０-９]{14,17}[０-９Ｘｘ]")
_TOWN = rf"{_HAN}{{2,3}}(?:省|市|县|区|州|镇|乡)"
_ZH_STREET = re.compile(
    rf"(?:{_TOWN}){{0,3}}(?:{_HAN}{{2}}(?:省|市|县|区|镇|乡)){_HAN}{{1,6}}?(?:大道|路|街|巷|里|道|弄|胡同)\s?{_D}{{1,5}}(?:[-－之]{_D}+)?(?:弄{_D}+)?号?"
    rf"(?:院)?(?:{_D}{{1,4}}(?:[-－]{_D}+)?(?:幢|栋|座|号楼|楼))?(?:{_D}{{1,3}}单元)?(?:{_D}{{1,5}}(?:[-－]{_D}+)?(?:室|房|户))?(?:[ ，,]?邮编[:：]?{_D}{{6}})?"
)
_WORD = rf"[{_UP}][{_LOW}'’-]+"
_TOWN_WORDS = rf"{_WORD}(?:[ -](?:upon|on|am|an der|sur|sous|la|le|les|de|du|der|bei|in|{_WORD}))*"
_EN_STREET = re.compile(
    rf"(?:(?:Flat|Unit|Apt\.?|Apartment|Suite|Room|Floor) ?[0-9]{{1,4}}[A-Za-z]?,? )?(?:[0-9]{{1,5}}(?:[A-Za-z]|[-/][0-9]+)?,? )?{_WORD}(?: {_WORD}){{0,2}} {STREET_EN}"
    rf"(?:,? (?:Flat|Unit|Apt\.?|Suite) ?[0-9]{{1,4}}[A-Za-z]?)?(?:, {_WORD}(?: {_WORD}){{0,1}})?(?:,? [A-Z]{{1,2}}[0-9][0-9A-Z]? ?[0-9][A-Z]{{2}}|,? [A-Z]{{2}} [0-9]{{5}}|,? [0-9]{{5}})?"
)
_DE_STREET = re.compile(rf"(?:(?:Am|An der|Im|In der|Zum|Zur|Auf dem|Alte[rn]?|Neue[rn]?) )?(?:[{_UP}][{_LOW}]+(?:er|-)? ?)?(?:[{_UP}][{_LOW}-]*)?{STREET_DE} [0-9]{{1,4}}(?: ?[a-hA-H]\b)?(?:[-/] ?[0-9]+)?(?:,? (?:D-)?[0-9]{{5}} {_WORD}(?: (?:am|an der|im|bei) {_WORD})?)?")
_FR_STREET = re.compile(rf"[0-9]{{1,4}}(?: ?(?:bis|ter|quater|[A-D])\b)?,? {STREET_FR} (?:(?:de la|de l['’]|des|du|de|d['’]|la|le|les) ?)?(?:{_WORD}|[{_LOW}]+)(?:[ -](?:de|du|des|la|le|les|{_WORD}))*(?:,? (?:F-)?[0-9]{{5}} {_WORD}(?:[ -](?:{_WORD}|sur|sous|en|la|le|les|de))*)?")
_TOKEN = rf"(?:(?:O['’]|Mc|[dl]['’])?[{_UP}][{_LOW}'’]+(?:-[{_UP}][{_LOW}]+)*|[{_UP}]{{2,}}(?:[-'’][{_UP}]{{2,}})*|[{_UP}]\.)"
_PARTICLE = r"(?:von der|von|van|de la|de|du|der|le|la)"
_WORD_REST = rf"[{_LOW}'’]+(?:-[{_UP}][{_LOW}]+)*"
#: A run of capitalised words, with particles and a comma between two of them. Its first word is _TOKEN again, but for what begins
#: the pattern: a set of signs, for which a text is searched faster than for what does not stand before it.
_RUN = re.compile(
    rf"[{_UP}dl](?<![\w@.-].)(?:(?:(?<=[Odl])['’]|(?<=M)c)[{_UP}]{_WORD_REST}|(?<![dl])(?:{_WORD_REST}|[{_UP}]+(?:[-'’][{_UP}]{{2,}})*|\.))"
    rf"(?:,? (?:{_PARTICLE} )?{_TOKEN})+(?![\w@])"
)
_TOKENS = re.compile(rf"({_PARTICLE} )?({_TOKEN})(,)?")
_GIVEN = r"[^\W\d_A-Za-zÀ-ÿ]"
_FUNCTION = "的了是在和与及或不也都就而但被把从到对向以于这那有我你他她它们个其之此所"
_HONORIFIC = re.compile("先生|女士|老师|同志|教授|小姐|博士|主任|经理|医生|律师|师傅")
_NUMBER_CORE = re.compile(r"[0-9０-９][0-9０-９ \-./()（）－·]{5,}[0-9０-９]")
_ZH_ANCHOR = re.compile(r"(?:路|街|巷|里|大道|道|弄|胡同)\s?[0-9０-９]")
_DIGIT = re.compile("[0-9]")
_FR_NUMBER = re.compile(r"[0-9](?: ?(?:bis|ter|quater|[A-D]))?,?$")

# --- fixed values: signs of a mail address and words of streets, by the generator that looks there
ANCHORS = {
    "@": ("@", "＠", "#", "＃", "(at)", "[at]", "{at}", "(AT)", "[AT]", "（at）", "(a)", "[a]", " at ", " AT ", "( at )", "[ at ]", " arobase ", "艾特"),
    "E": tuple(f" {w}" for w in "Street St Road Rd Lane Ln Avenue Ave Crescent Cres Close Drive Dr Court Ct Place Pl Square Sq Terrace Way Hill Row Gardens Boulevard Blvd Walk Mews Parade Green Yard Quay Wharf Grove Park View Rise Vale Circus Circle Highway Parkway Alley Gate Croft Esplanade Promenade".split()),
    "D": tuple(f"{w} " for w in "traße trasse tr. Weg weg Platz platz Allee allee Gasse gasse Ring ring Ufer ufer Damm damm Markt markt Steig steig haussee".split()),
    "F": tuple(f" {w} " for w in "rue avenue av. boulevard bd chemin quai place impasse allée allee cours route square passage sentier venelle".split()),
}


@cache
def _anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for use, words in ANCHORS.items():
        for word in words:
            automaton.add_word(word, (use, len(word)))
    automaton.make_automaton()
    return automaton


def spans(text: str) -> list[Span]:
    """All proposed spans of ``text``; they overlap, and most are no personal data."""
    joined = _Joined([text])
    _, start, end = _han_names(joined)
    return sorted(_other_spans(joined)[0] | {Span(NAME, *x) for x in zip(start.tolist(), end.tolist())})


def described(texts: list[str], frequent: Mapping[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all proposed spans of ``texts``, by text and in the order of ``spans``: the text's index, the spans as rows of kind,
    start and end, and their features as rows."""
    joined = _Joined(texts)
    other = _other_spans(joined)
    found = [(i, *s) for i, own in enumerate(other) for s in own]
    rows = [features(text, s, frequent) for text, own in zip(texts, other) for s in own]
    doc, start, end = _han_names(joined)
    at = joined.offsets[doc]
    table = np.concatenate([np.array(found, dtype=np.int64).reshape(-1, 4), np.stack([doc, np.full(len(doc), NAME), start, end], axis=1)])
    x = np.concatenate([np.array(rows, dtype=float).reshape(-1, FEATURES), _han_features(joined, at + start, at + end, _pair_shares(frequent))])
    order = np.lexsort(table.T[::-1])
    return table[order, 0], table[order, 1:], x[order]


def _other_spans(joined: _Joined) -> list[set[Span]]:
    """All proposed spans of each text but Han names."""
    found = [_spans_of(text) for text in joined.texts]
    for i, at, end in _coded(joined):
        text = joined.texts[i]
        for m in _CODE.finditer(text, max(0, at - CODE_CHARS), end + CODE_CHARS):
            found[i].add(Span(ID_NUMBER, *m.span()))
    return found


def _coded(joined: _Joined) -> Iterator[tuple[int, int, int]]:
    """(text, start, end) of runs of two digits and more with a capital next to them, at most a space between, or another mark of a code."""
    cls, chars = joined.classes, joined.chars
    digit = (chars >= ord("0")) & (chars <= ord("9"))
    edge = np.flatnonzero(digit[1:] != digit[:-1]) + 1
    edge = np.concatenate([[0], edge]) if digit[0] else edge
    at, end = edge[::2], edge[1::2]
    at, end = at[end - at > 1], end[end - at > 1]
    doc = np.searchsorted(joined.offsets, at, side="right") - 1
    first, past = joined.offsets[doc], joined.offsets[doc + 1] - 1
    bit = lambda k, flag: (cls[k] & flag) != 0
    before = (at > first) & bit(at - 1, _C_UPPER) | (at - 1 > first) & bit(at - 1, _C_SPACE) & bit(at - 2, _C_UPPER)
    after = (end < past) & bit(end, _C_UPPER) | (end + 1 < past) & bit(end, _C_SPACE) & bit(end + 1, _C_UPPER)
    marked = before | after | (chars[end] == ord("x")) | (end - at == 6) & (chars[end] == ord(" "))
    return zip(doc[marked].tolist(), (at - first)[marked].tolist(), (end - first)[marked].tolist())


def _spans_of(text: str) -> set[Span]:
    """The spans of one text that patterns find in it."""
    out: set[Span] = set()
    for end, (use, n) in _anchors().iter(text):
        end += 1
        if use == "@":
            _add_email(text, end - n, out)
        elif use == "E":
            _add_street(_EN_STREET, text, end - n, end, out)
        elif use == "D":
            if _DIGIT.match(text, end):
                _add_street(_DE_STREET, text, end - n, end, out)
        elif _FR_NUMBER.search(text, max(0, end - n - 12), end - n):
            _add_street(_FR_STREET, text, end - n, end, out)
    for run in _RUN.finditer(text):
        _add_latin_names(text, run.start(), run.end(), out)
    for core in _NUMBER_CORE.finditer(text):
        _add_numbers(text, core.start(), core.end(), out)
    if "０" in text or "９" in text:
        for m in _WIDE_CODE.finditer(text):
            out.add(Span(ID_NUMBER, *m.span()))
    for anchor in _ZH_ANCHOR.finditer(text):
        _add_han_address(text, anchor.start(), out)
    return out


#: No code that _CODE can match is longer, and no Chinese address reaches further before its street's number or after it.
CODE_CHARS = 48
HAN_BEFORE, HAN_AFTER = 26, 72
#: Words before and after the word for a street that an address can hold.
STREET_WORDS = 9


def _add_latin_names(text: str, start: int, end: int, out: set[Span]) -> None:
    """Every two and three neighbouring words of a run of capitalised words, but for words that no person is called by.

    A comma may part the family name from the given name. Words of organisations end a run, and what stands right before
    such a word belongs to it.
    """
    if text[max(0, start - 4) : start].lower() == "the ":
        return  # no person is called with it
    words: list[tuple[int, int, bool]] = []  # start, end, comma after it
    for m in [*_TOKENS.finditer(text, start, end), None]:
        word = m and m[2]
        kind = word and _kind_of_word(word)
        organisation = kind == "organisation"
        if m and (not kind or kind == "title" and words):
            words.append((m.start(), m.end(2), bool(m[3])))
            continue
        if not organisation:
            _add_windows(text, words, out)
        elif len(words) > 2:
            _add_windows(text, words[:-2], out)  # two words before it are its name
        words = []


@lru_cache(100_000)
def _kind_of_word(word: str) -> str:
    """Why a capitalised word is no part of a name; empty where it may be one."""
    if _ORG_WORD.fullmatch(word):
        return "organisation"
    if word in STARTERS or word.capitalize() in STARTERS:
        return "starter"
    return "title" if _TITLE_WORD.fullmatch(word) and word != "M." else ""


def _add_windows(text: str, words: list[tuple[int, int, bool]], out: set[Span]) -> None:
    for i in range(len(words) - 1):
        for n in (2, 3):
            own = words[i : i + n]
            commas = sum(w[2] for w in own[:-1])
            if len(own) == n and (not commas or own[0][2] and commas == 1) and not text[own[-1][0] : own[-1][1]].endswith("."):
                first = own[0][0] if text[own[0][0]].isupper() else text.index(" ", own[0][0]) + 1
                out.add(Span(NAME, first, own[-1][1]))


class _Joined:
    """Texts in one row, a line's end after each, as a string and as arrays. No Han name and none of its features goes beyond a line."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.text = "\n".join([*texts, "\n\n\n"])  # the signs next to a span can be looked at anywhere
        self.chars, _ = code_points([self.text])
        self.offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.offsets[1:])
        self.classes = _classes()[self.chars]

    def pairs(self, at: np.ndarray) -> np.ndarray:
        """The signs at ``at`` and after them as numbers, as ``_pair_codes`` has them."""
        return self.chars[at].astype(np.int64) << 16 | self.chars[at + 1]

    def within(self, flag: int, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many signs of a class stand in each stretch, and where the first one from its start on is."""
        at = np.flatnonzero((self.classes & flag) != 0)
        first = np.searchsorted(at, start)
        return np.searchsorted(at, end) - first, np.append(at, len(self.chars))[first]

    def only(self, flag: int, at: np.ndarray, stop: np.ndarray, step: int) -> np.ndarray:
        """Whether there are signs of a class only from ``at`` on, step by step, until ``stop``, which is near."""
        out, at, open_ = np.zeros(len(at), dtype=bool), at.copy(), np.arange(len(at))
        while len(open_):
            out[open_] = at[open_] == stop[open_]
            open_ = open_[~out[open_] & ((self.classes[at[open_]] & flag) != 0)]
            at[open_] += step
        return out


#: Classes of signs, as bits.
_C_HAN, _C_FAMILY, _C_BEFORE, _C_AFTER, _C_FUNCTION, _C_OBJECT, _C_GIVEN, _C_DOT, _C_PERSON, _C_LEADS, _C_SPACE, _C_ISDIGIT, _C_DIGIT, _C_AT, _C_CUE, _C_LOWER, _C_LINE, _C_UPPER, _C_LEFT, _C_RIGHT = (1 << k for k in range(20))
#: Signs that NAME_WORDS begin with.
_CUE_STARTS = "姓联负作编署名人者员师长生NnAaEeRrSsCcFfDdVvPpBbg—–"


@cache
def _classes() -> np.ndarray:
    """The classes of every code point."""
    table = np.zeros(0x110000, dtype=np.int32)
    table[0x4E00:0xA000] = _C_HAN
    members = {
        _C_FAMILY: SURNAMES, _C_BEFORE: BEFORE_HAN, _C_AFTER: AFTER_HAN, _C_FUNCTION: _FUNCTION, _C_OBJECT: OBJECT_ENDS, _C_GIVEN: GIVEN_HAN, _C_DOT: "　·•", _C_PERSON: "人者员师长生", _C_LEADS: "据经由被请让给对向找问见与和跟同及",
        _C_SPACE: (c for c in map(chr, range(0x10000)) if c.isspace()), _C_ISDIGIT: (c for c in map(chr, range(0x20000)) if c.isdigit()), _C_DIGIT: "0123456789０１２３４５６７８９", _C_AT: "@＠", _C_CUE: _CUE_STARTS, _C_LOWER: "abcdefghijklmnopqrstuvwxyz", _C_LEFT: " -*>|—–　", _C_RIGHT: " |　\r", _C_LINE: "\n", _C_UPPER: (c for c in map(chr, range(0x20000)) if c.isupper()),
    }
    for flag, signs in members.items():
        table[[*{*map(ord, signs)}]] |= flag
    return table


@cache
def _signs() -> np.ndarray:
    """What _SIGNS has of every code point, and 1 of other space in a line."""
    table = (_classes() & (_C_SPACE | _C_LINE) == _C_SPACE).astype(np.int8)
    table[[*map(ord, _SIGNS)]] = [*_SIGNS.values()]
    return table


def _pair_codes(pairs: Iterable[str]) -> np.ndarray:
    return np.array([ord(a) << 16 | ord(b) for a, b in pairs], dtype=np.int64)


_COMMON_CODES = np.sort(_pair_codes(COMMON_WORDS))


def _pair_shares(frequent: Mapping[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """The frequent pairs of Han signs as sorted numbers, and their shares."""
    pairs = [w for w in frequent if len(w) == 2 and _IS_HAN.match(w) and _IS_HAN.match(w, 1)]
    codes, values = _pair_codes(pairs), np.array([frequent[w] for w in pairs], dtype=float)
    order = np.argsort(codes)
    return codes[order], values[order]


def _share(known: tuple[np.ndarray, np.ndarray], codes: np.ndarray) -> np.ndarray:
    if not len(known[0]):
        return np.zeros(len(codes))
    at = np.minimum(np.searchsorted(known[0], codes), len(known[0]) - 1)
    return np.where(known[0][at] == codes, known[1][at], 0.0)


def _han_names(joined: _Joined) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Han names as the text's index, start and end in it: a family name and one or two signs at the edges of words, and two or
    three signs that stand alone, or two parts of a name with a sign between them."""
    cls = joined.classes
    common = lambda at: np.isin(joined.pairs(at), _COMMON_CODES)
    is_ = lambda at, flag: (cls[at] & flag) != 0
    out: list[tuple[np.ndarray, np.ndarray]] = []
    at = np.flatnonzero((cls & _C_FAMILY) != 0)
    at = at[(cls[at - 1] & (_C_BEFORE | _C_HAN) != _C_HAN) & (cls[at + 1] & (_C_HAN | _C_FUNCTION) == _C_HAN) & ~is_(at + 2, _C_FUNCTION)]
    at = at[~common(at)]
    one = at[(cls[at + 2] & (_C_AFTER | _C_HAN) != _C_HAN) & ~is_(at + 1, _C_OBJECT)]
    two = at[cls[at + 2] & (_C_HAN | _C_OBJECT) == _C_HAN]
    out += [(one, one + 2), (two, two + 3)]
    han = is_(slice(None), _C_HAN)
    edge = np.flatnonzero(han[1:] != han[:-1]) + 1
    edge = np.concatenate([[0], edge]) if han[0] else edge  # runs of Han signs, first and past the last; the row ends with none
    first, past = edge[::2], edge[1::2]
    parted = is_(past, _C_DOT) & han[np.minimum(past + 1, len(han) - 1)]  # a sign and more signs after the run
    n = past - first
    alone = (n >= 2) & (n <= 3) & ~parted & ~is_(first - 1, _C_DOT)
    out.append((first[alone], past[alone]))
    at = past[parted] - 1
    whole = at + 3 + han[at + 3]
    out.append((at, whole))
    start, end = (np.concatenate([x[k] for x in out[2:]]) for k in (0, 1))
    kept = ~common(start) & ~is_(end - 1, _C_OBJECT)
    out[2:] = [(start[kept], end[kept]), (at, at + 3)]
    titled = [m.start() for m in _HONORIFIC.finditer(joined.text)]
    for n in (2, 3):
        own = np.array([k for k in titled if k >= n and han[k - n : k].all()], dtype=np.int64)
        out.append((own - n, own))
    spans_ = np.unique(np.concatenate([start << 3 | end - start for start, end in out]).astype(np.int64))
    start, n = spans_ >> 3, spans_ & 7
    doc = np.searchsorted(joined.offsets, start, side="right") - 1
    start = start - joined.offsets[doc]
    return doc, start, start + n


_IS_HAN = re.compile(_HAN)
_ORG_WORD = re.compile(rf"(?:{ORGANISATION})|\w+(?:{ORGANISATION})")
_TITLE_WORD = re.compile(TITLES)
_LOCAL_SIGNS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def _add_email(text: str, at: int, out: set[Span]) -> None:
    m = _AT.match(text, max(0, at - 1)) or _AT.match(text, at)
    if not m:
        return
    left = m.start()
    while left and text[left - 1] in _LOCAL_SIGNS:
        left -= 1
    while left < m.start() and not text[left].isalnum():
        left += 1
    right = left < m.start() and _HOST.match(text, m.end())
    if right:
        out.add(Span(EMAIL, left, right.end()))


#: Days as numbers; they are proposed as nothing.
_DAY = re.compile(r"(?:19|20)[0-9]{2}[-./](?:0?[1-9]|1[0-2])[-./](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[-./](?:0?[1-9]|1[0-2])[-./](?:19|20)[0-9]{2}")


def _add_numbers(text: str, start: int, end: int, out: set[Span]) -> None:
    """Every sub-run of consecutive digit groups in a run whose number of digits fits; they overlap."""
    groups = [m.span() for m in _GROUPS.finditer(text, start, end)]
    for i, (at, _) in enumerate(groups):
        lead = _LEAD.search(text, max(0, at - 3), at)
        first = lead.start() if lead else at
        if first and text[first - 1].isascii() and (text[first - 1].isalnum() or text[first - 1] in "*_" and _MASK.search(text, max(0, first - 20), first)):
            continue
        digits = 0
        for j in range(i, len(groups)):
            if j > i and groups[j][0] - groups[j - 1][1] > 3:
                break
            to = groups[j][1]
            digits += to - groups[j][0]
            if digits > 18:
                break
            if digits < 7 or to < len(text) and text[to].isascii() and text[to].isalnum():
                continue
            run = text[first:to]
            if _DAY.fullmatch(run):
                continue
            s = first
            if lead and run.count("(") + run.count("（") > run.count(")") + run.count("）"):
                s = at if text[first] in "(（" else first
            if digits <= 15:
                out.add(Span(PHONE, s, to))
                extension = _EXTENSION.match(text, to)
                if extension:
                    out.add(Span(PHONE, s, extension.end()))
            if digits >= 8:
                out.add(Span(ID_NUMBER, s, to))


#: What may stand before the first digit group of a number, and digits that are masked up to it.
_LEAD = re.compile(r"(?:[+＋]\s?)?[(（]$|[+＋]\s?$")
_MASK = re.compile(r"[0-9０-９][*_-]*[*_]$")


def _add_han_address(text: str, anchor: int, out: set[Span]) -> None:
    for m in _ZH_STREET.finditer(text, max(0, anchor - HAN_BEFORE), anchor + HAN_AFTER):
        if m.start() < anchor < m.end():
            out.add(Span(ADDRESS, *m.span()))
            for k in range(1, m.end() - m.start()):  # a town may be proposed with what stands before it
                if m.start() + k + 4 >= anchor:
                    break
                if _TOWN_AT.match(text, m.start() + k):
                    out.add(Span(ADDRESS, m.start() + k, m.end()))


_TOWN_AT = re.compile(rf"{_HAN}{{2}}[省市县区镇乡]")


def _add_street(pattern: re.Pattern, text: str, at: int, end: int, out: set[Span]) -> None:
    """Addresses around the word for a street at ``at`` to ``end``, within STREET_WORDS words; they hold a number."""
    first, last = at, end
    for _ in range(STREET_WORDS):
        first = max(text.rfind(" ", 0, first), text.rfind("\n", 0, first), 0)
        last = text.find(" ", last + 1)
        if last < 0:
            last = len(text)
    if not _DIGIT.search(text, first, last):
        return
    for m in pattern.finditer(text, first, last):
        if m.start() < end and m.end() > at and _DIGIT.search(m.group()):
            out.add(Span(ADDRESS, *m.span()))


_CTX = re.compile("|".join(f"({p})" for p in (PHONE_WORDS, ID_WORDS, MAIL_WORDS, ADDRESS_WORDS, NUMBER_WORDS)))
_CUE = re.compile(NAME_WORDS)
_AFTER_NUMBER, _ORG = re.compile(NUMBER_AFTER), re.compile(ORGANISATION)
_GROUPS = re.compile(rf"{_D}+")
_GROUP_OF_7 = re.compile(rf"{_D}(?:[ .()（）/-]{{0,2}}{_D}){{6,}}")
FEATURES = 56


#: A digit group next to a span and what parts it from the span.
_GROUP_LEFT = re.compile(rf"({_D}+)([ \-./()（）－·+＋]{{1,4}})$")
_GROUP_RIGHT = re.compile(rf"([ \-./()（）－·+＋]{{1,4}})({_D}+)")


def _parting(separator: str) -> float:
    """1: a sign alone, 2: a space alone, 3: a sign between spaces or a plus."""
    return 2.0 if separator == " " else 1.0 if len(separator) == 1 else 3.0


def _beside(left: str, right: str) -> list[float]:
    """How the digit groups before and after a span are parted from it and how long they are, and other digits there."""
    before, after = _GROUP_LEFT.search(left), _GROUP_RIGHT.match(right)
    f = [_parting(before[2]), float(len(before[1]))] if before else [0.0, 0.0]
    f += [_parting(after[1]), float(len(after[2]))] if after else [0.0, 0.0]
    run_left, run_right = _RUN_LEFT.search(left), _RUN_RIGHT.match(right)
    return [*f, float(sum(map(str.isdigit, run_left[0]))), float(sum(map(str.isdigit, run_right[0])))]


_RUN_LEFT, _RUN_RIGHT = re.compile(r"[0-9０-９ \-./()（）－·+＋]*$"), re.compile(r"[0-9０-９ \-./()（）－·+＋]*")
_NARROW = {0xFF10 + i: 0x30 + i for i in range(10)} | {0xFF38: "X"}


def _narrow(text: str) -> str:
    return text.translate(_NARROW)


def _plausible_birth(digits: str) -> float:
    """Whether digits 7 to 14 are a date."""
    if len(digits) < 14:
        return 0.0
    y, m, d = int(digits[6:10]), int(digits[10:12]), int(digits[12:14])
    return float(1900 <= y <= 2030 and 1 <= m <= 12 and 1 <= d <= 31)


def capitalised(text: str) -> set[str]:
    """The different words of a text that begin with a capital."""
    return set(_CAPITAL.findall(text))


def features(text: str, span: Span, frequent: Mapping[str, float]) -> list[float]:
    """What ``span`` looks like: its format, then its surroundings, as FEATURES numbers; names have features of their own.

    ``frequent``: pairs of Han signs and capitalised words that stand in many texts, with the per cent of the texts.
    """
    s = text[span.start : span.end]
    if span.kind == NAME and _IS_HAN.match(s):
        return _han_features(_Joined([text]), np.array([span.start]), np.array([span.end]), _pair_shares(frequent))[0].tolist()
    line_start = text.rfind("\n", 0, span.start) + 1
    stop = text.find("\n", span.end)
    line_end = stop if stop >= 0 else len(text)
    own = _name_features if span.kind == NAME else _number_features
    line = text[line_start:line_end] if line_end - line_start < 200 else text[max(line_start, span.start - 80) : min(line_end, span.end + 80)]
    f = own(s, text[max(line_start, span.start - 44) : span.start], text[span.end : min(line_end, span.end + 24)], line, span.kind)
    if span.kind == NAME:
        words = [frequent.get(w, 0.0) for w in _CAPITAL.findall(s)] or [0.0]
        f += [words[0], words[-1], max(words), min(words)]
    return [*map(float, f), *[0.0] * (FEATURES - len(f))]


def _number_features(s: str, left: str, right: str, line: str, kind: int) -> list:
    narrow = s if s.isascii() else _narrow(s)
    groups = _GROUPS.findall(narrow)
    digits = "".join(groups)
    f = [kind == k for k in range(4)]
    f += [len(s), len(digits), sum(map(str.isalpha, s)), len(groups), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, max(map(len, groups), default=0)]
    f += [narrow.startswith(("+", "00", "＋")), narrow[:1] == "0", bool(_MOBILE.match(narrow)) and len(digits) in (11, 13, 15), narrow[:1] in "(（", " " in s, "-" in s, "." in s, "/" in s]
    f += [bool(_EXTENDED.search(s)), narrow[-1:] == "X", _plausible_birth(digits), 2015 <= int(digits[:4] or 0) <= 2030, digits[:3] in ("978", "979"), digits[:2] in ("19", "20") and len(digits) == 8]
    f += [bool(_DATE_LIKE.match(narrow)), s.count(".") >= 2 and bool(_DOTTED.fullmatch(s)), "A" <= s[:1] <= "Z", "A" <= s[-1:] <= "Z"]
    nearest, last = -1, [-40] * 5
    for m in _CTX.finditer(left):
        nearest = m.lastindex - 1
        last[nearest] = m.end() - len(left)
    f += [*last, nearest, bool(_AFTER_NUMBER.match(right)), not left.strip(" -*>|"), not right.strip(" |.。"), "|" in left[-2:], "|" in right[:2]]
    before = left[-1:]
    f += [len(_GROUP_OF_7.findall(line)), "@" in line or "＠" in line, "一" <= s[:1] <= "鿿", before in BEFORE_HAN or not _IS_HAN.match(before) if before else True, bool(_TOWN_NEXT.search(s[3:5])), bool(_POSTCODE.search(s))]
    return f + (_beside(left, right) if kind in (PHONE, ID_NUMBER) else [0] * 6)


_CAPITAL = re.compile(rf"[{_UP}](?<!\w.)[\w'’-]+")  # the set first: the search is faster
_MOBILE, _EXTENDED, _DOTTED = re.compile(r"(?:\+86 ?|0086)?1[3-9]?\d"), re.compile(r"转|ext|Durchwahl|poste|分机"), re.compile(r"[\d.]+")
_DATE_LIKE = re.compile(r"\d{4}[-./]\d{1,2}[-./]\d{1,2}(?!\d)|\d{1,2}[./]\d{1,2}[./]\d{4}")
_TOWN_NEXT, _POSTCODE = re.compile("[市县区省]"), re.compile(r"\d{5} [A-ZÀ-Þ]|[A-Z]{1,2}\d[0-9A-Z]? ?\d[A-Z]{2}")
_WORD_LEFT, _WORD_RIGHT = re.compile(r"([\w'’]+)\W{1,2}$"), re.compile(r"\W{0,3}?([^\W\d]+)")
_SIGNS = {c: k for k, c in enumerate(",.:;(|—–'’\"“「》）)、。，：；（", 2)}


def _word_class(word: str) -> int:
    """1: determiner, 2: preposition, 3: conjunction, 4: title, 5: with a capital, 6: a number, 7: ends like a verb, 8: another,
    9: a preposition of place."""
    low = word.lower()
    for k, words in ((1, DETERMINERS), (9, PLACE_PREPOSITIONS), (2, PREPOSITIONS), (3, CONJUNCTIONS)):
        if low in words:
            return k
    if _TITLE_WORD.fullmatch(word):
        return 4
    if word[:1].isupper():
        return 5
    return 6 if word[:1].isdigit() else 7 if low.endswith(("ed", "es", "te", "it", "ait", "hat", "ist", "as", "id", "ll", "was", "ote", "ame", "eft", "aid")) else 8


def _name_features(s: str, left: str, right: str, line: str, kind: int) -> list:
    alone_left, alone_right = not left.strip(" -*>|—–　"), not right.strip(" |　\r")
    cue = None
    for cue in _CUE.finditer(left[-24:]):
        pass
    f = [False, len(s), alone_left, alone_right, "|" in left[-2:], "|" in right[:2], "@" in line or "＠" in line, len(_GROUP_OF_7.findall(line)), len(line)]
    f += [cue.end() - len(left[-24:]) if cue else -40, _SIGNS.get(left[-1:], 1 if left[-1:].isspace() else 0), _SIGNS.get(right[:1], 1 if right[:1].isspace() else 0), bool(_ORG.search(s)), bool(_ORG.search(right[:18])), right[:4].strip()[:1].isdigit()]
    words = s.replace(",", "").split(" ")
    before, after = _WORD_LEFT.search(left), _WORD_RIGHT.match(right)
    f += [0] * 15
    f += [len(words), sum(len(w) == 2 and w[1] == "." for w in words), sum(len(w) > 2 and w.isupper() for w in words), "," in s, "-" in s, min(map(len, words)), max(map(len, words)), sum(w in STARTERS for w in words)]
    f += [_word_class(before[1]) if before else 0, _word_class(after[1]) if after else 0, bool(before) and before[0][-2:-1] != "." and before[1][:1].isupper(), bool(after) and right[:1] == " " and after[1][:1].isupper(), len(after[1]) if after else 0]
    f += [left.rstrip()[-1:] in ".!?。！？" or alone_left, len(before[1]) if before else 0]
    # text in capitals throughout
    return [*f, sum(map(str.isupper, left[-20:])) / (1 + sum(map(str.isalpha, left[-20:]))), sum(map(str.isupper, right[:20])) / (1 + sum(map(str.isalpha, right[:20])))]


def _han_features(joined: _Joined, start: np.ndarray, end: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Features of Han names, for all spans of the row at once; those that ``_name_features`` has too stand at the same places.

    ``known``: the frequent pairs, as ``_pair_shares`` has them.
    """
    x = np.zeros((len(start), FEATURES))
    if not len(start):
        return x
    text, cls, chars = joined.text, joined.classes, joined.chars
    lines = np.flatnonzero(chars == 10)
    k = np.searchsorted(lines, start)
    line_start, line_end = np.where(k > 0, lines[k - 1] + 1, 0), lines[k]
    before, after = cls[start - 1], cls[end]
    some_left, some_right = before & _C_LINE == 0, after & _C_LINE == 0
    bit = lambda c, flag: (c & flag) != 0

    x[:, 0], x[:, 1] = 1, end - start
    x[:, 2] = joined.only(_C_LEFT, start - 1, np.maximum(line_start, start - 44) - 1, -1)
    x[:, 3] = joined.only(_C_RIGHT, end, np.minimum(line_end, end + 24), 1)
    bar = ord("|")
    x[:, 4] = (chars[start - 1] == bar) | some_left & (chars[start - 2] == bar)
    x[:, 5] = (chars[end] == bar) | some_right & (chars[end + 1] == bar)
    wide = line_end - line_start >= 200
    low, high = np.where(wide, np.maximum(line_start, start - 80), line_start), np.where(wide, np.minimum(line_end, end + 80), line_end)
    x[:, 6] = joined.within(_C_AT, low, high)[0] > 0
    numbers: dict[tuple[int, int], int] = {}
    for i in np.flatnonzero(joined.within(_C_DIGIT, low, high)[0] >= 7).tolist():
        own = int(low[i]), int(high[i])
        if own not in numbers:
            numbers[own] = len(_GROUP_OF_7.findall(text, *own))
        x[i, 7] = numbers[own]
    x[:, 8], x[:, 9] = high - low, -40
    cues, at = joined.within(_C_CUE, np.maximum(line_start, start - 24), start)
    for i in np.flatnonzero(cues).tolist():
        cue, to = None, int(start[i])
        for cue in _CUE.finditer(text, int(at[i]), to):
            pass
        if cue:
            x[i, 9] = cue.end() - to
    signs = _signs()
    x[:, 10], x[:, 11] = signs[chars[start - 1]], signs[chars[end]]
    to = np.minimum(line_end, end + 18)
    for i in np.flatnonzero(joined.within(_C_LOWER, end, to)[0] >= 2).tolist():
        x[i, 13] = bool(_ORG.search(text[end[i] : to[i]]))
    near, open_ = np.zeros(len(start), dtype=bool), np.ones(len(start), dtype=bool)
    for n in range(4):  # the first sign after space
        open_ &= end + n < line_end
        c = cls[np.minimum(end + n, line_end)]
        near |= open_ & bit(c, _C_ISDIGIT)
        open_ &= bit(c, _C_SPACE)
    x[:, 14] = near

    parted = bit(cls[start + 1], _C_DOT)
    x[:, 15], x[:, 16], x[:, 17] = bit(cls[start], _C_FAMILY), end - start - 1 - parted, parted
    for n in range(1, int((end - start).max())):
        c = np.where(start + n < end, cls[np.minimum(start + n, end)], 0)
        x[:, 18] += bit(c, _C_GIVEN)
        x[:, 21] += bit(c, _C_FAMILY)
    x[:, 21] = x[:, 21] > 0
    x[:, 19] = np.isin(joined.pairs(start), _COMMON_CODES) | np.isin(joined.pairs(end - 2), _COMMON_CODES)
    x[:, 20] = bit(cls[end - 1], _C_AFTER)
    for n, flag in ((22, _C_BEFORE), (23, _C_PERSON), (24, _C_LEADS)):
        x[:, n] = np.where(some_left, bit(before, flag), -1)
    x[:, 25] = bit(before, _C_HAN)
    x[:, 26], x[:, 27] = np.where(some_right, bit(after, _C_AFTER), -1), bit(after, _C_HAN)
    x[:, 28], x[:, 29] = np.isin(joined.pairs(end), _COMMON_CODES), np.isin(joined.pairs(end), _HONORIFIC_CODES)

    x[:, 31] = np.inf
    for n in range(int((end - start).max()) - 1):
        there = start + n + 1 < end
        share = _share(known, joined.pairs(start + n))
        x[:, 30] = np.where(there, np.maximum(x[:, 30], share), x[:, 30])
        x[:, 31] = np.where(there, np.minimum(x[:, 31], share), x[:, 31])
    x[:, 32], x[:, 33] = _share(known, joined.pairs(start - 1)), _share(known, joined.pairs(end - 1))
    return x


_HONORIFIC_CODES = np.sort(_pair_codes(_HONORIFIC.pattern.split("|")))
