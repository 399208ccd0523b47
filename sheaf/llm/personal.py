"""Personal information in free text: labelers vote, EM weighs them, a span classifier decides.

Wide patterns propose spans (e-mail, phone, identity number, address, name).  A Chinese name is proposed wherever a
surname is followed by any one or two Han characters and something stands on its left or right that may stand beside a
name; a Latin one wherever two capitalised words meet.  Labelers, each a regex, gazetteer or context test, vote +1, -1
or 0 on every span.  Three labelers of names have no list: which characters and words names are made of, and what stands
before and after them, is counted over all rows, first in spans that a role word introduces, then in spans made of
such characters (``learned``); the tables have a fixed number of hashed places.

How often each combination of votes occurs is counted over all rows, and expectation-maximisation on these counts
estimates every labeler's reliability and each span's probability.  A logistic classifier on votes and shape begins with
the reliabilities' log odds as weights, is trained on a bounded sample of spans (``sample_spans``, a documented
parameter) with the probabilities as soft labels, and decides all spans; of overlapping ones the best is kept.

Edge cases: null and empty texts give no row; texts of any length are read whole; line breaks within an item are
tolerated; masked or bracketed stand-ins are no spans; repeated rows give their items once; with no span at all
nothing is trained and the result is empty.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.vectorised import vectorised
from sheaf.llm.names import COMPOUND, ENGLISH_LINE_OF, NICKNAMES
from sheaf.sources.tables import materialise, spread, table

# Frequent surnames, and English given names (with the nicknames of names.py).
SURNAMES = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾萧田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
    "康常温施牛樊葛邢安齐易乔庞颜庄聂章鲁岳翟殷詹申欧耿关兰焦俞左柳甘祝包宁尚符舒阮柯纪梅童凌毕单裴霍涂苗柴蒙骆穆尤辛娄褚"
)
GIVEN_NAMES = {n.capitalize() for n in NICKNAMES} | {w.capitalize() for v in NICKNAMES.values() for w in v.split()} | set("Laura Alice Helen Sarah Emily Julia Martha Agnes Oliver Hugh Simon Peter Paul Mark David Martin Graham Alan Brian Kevin Colin Walter Arthur Harold".split())
N = r"\n?"  # a line may break here
SP = r"[ \n]"
GAP = r"[- .\n]{0,2}"
def _d(n: int) -> str:  # noqa: E302
    return r"\d(?:\n?\d){%d}" % (n - 1)


HAN = "一-鿿"
#: Han characters that may end the words before a name (roles, kin, verbs and prepositions), and begin those after one.
BEFORE_NAME = "人方者员主办名字签印证本叫系是为由据与和及同跟找向给交请让代父母妻夫子女姐妹兄弟生士师长理后问称到即询并"
AFTER_NAME = "先女小同老的之等和与及、说称述陈表自本签收领代所于在已未将应可须当共转住现系是为出到持因经身电手联号不"
STREET_EN = r"(?:Street|St|Terrace|Lane|Quay|Rd|Road|Avenue|Ave|Drive|Close|Row|Way|Square|Place|Court|Gardens|Hill|Wharf)"
STEM = f"(?:[{HAN}]{N})"
CN_NUM = f"(?:{_d(1)}(?:{N}\\d)*|[一二三四五六七八九十百千零〇](?:{N}[一二三四五六七八九十百千零〇])*)"
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9][\w.+\-]*(?: ?[(\[（] ?at ?[)\]）] ?| ?[@＠#] ?)[A-Za-z][A-Za-z0-9\-]*(?: ?[\[(（] ?dot ?[\])）] ?[A-Za-z]{2,}|\.[A-Za-z]{2,})+", re.ASCII),
    "id_number": re.compile(
        rf"(?=[\dA-Z])(?<![\dA-Za-z])(?<!\d\n)(?:{_d(6)}[- \n]?(?:1{N}9|2{N}0)(?:{N}\d){{2}}(?:{N}\d){{4}}[- \n]?{_d(3)}{N}[\dXx]|{_d(3)}-{N}{_d(2)}-{N}{_d(4)}|[A-Z]{{2}}[ \n]\d\d[ \n]\d\d[ \n]\d\d[ \n][A-D]|[A-Z]{{1,2}}{N}{_d(7)}(?:{N}\d)?)(?!{N}[\dA-Za-z])"
    ),
    "phone": re.compile(
        rf"(?=[\d+(（])(?<![\dA-Za-z.*])(?<!\d\n)(?<!\d-)(?:(?:\+{N}8{N}6{GAP})?1{N}[3-9]{N}\d{GAP}{_d(4)}{GAP}{_d(4)}|(?:\+{N}8{N}6{GAP})?(?:[（(]{N}0{_d(1)}(?:{N}\d){{1,2}}{N}[)）]|0{N}\d(?:{N}\d){{1,2}}){GAP}{_d(4)}{GAP}{_d(3)}(?:{N}\d)?(?:[ \n]?转[ \n]?{_d(1)}(?:{N}\d)*)?"
        rf"|\+{N}1{GAP}\(?{_d(3)}\)?{GAP}{_d(3)}{GAP}{_d(4)}|\({N}{_d(3)}{N}\){GAP}{_d(3)}{GAP}{_d(4)}|{_d(3)}\.{N}{_d(3)}\.{N}{_d(4)}|\+{N}4{N}4{GAP}{_d(4)}{GAP}{_d(6)})(?:[ \n]?(?:ext\.?|x)[ \n]?\d{{1,5}})?(?!{N}[\d*])"
    ),
    "address_zh": re.compile(
        rf"(?:(?:({STEM}{{2,4}}?)(?:省|自{N}治{N}区){N})?(?:({STEM}{{2,4}}?)[市州]{N})?(?:({STEM}{{2,4}}?)[区县旗]{N})?(?:({STEM}{{2,4}}?)[镇乡村]{N})?)?({STEM}{{1,6}}?)(?:路|街|巷|大{N}道|胡{N}同){N}{CN_NUM}{N}(?:弄{N}{CN_NUM}{N}号|号|弄)(?:{N}{CN_NUM}{N}(?:幢|栋|号楼|座|单元|室|层|楼)|{N}单{N}元|(?<=[幢栋座]){N}{CN_NUM}{N}单{N}元)*(?:(?<=[幢栋座元]){N}\d(?:{N}\d)*{N}室?)?"
    ),
    "address_en": re.compile(
        rf"(?:(?:Flat|Unit|Apt|Apartment|Suite){SP}\d+[A-Z]?,{SP})?\b\d{{1,5}}[A-Z]?{SP}(?:[A-Z][a-z]+(?:-\n[a-z]+)?{SP}){{1,3}}?{STREET_EN}\b\.?(?:,{SP}(?:(?:Port|Great|Little|St|New|North|South|East|West|Upper|Lower){SP})?[A-Z][a-z]+(?:-\n[a-z]+)?)?"
    ),
    "name_zh": re.compile(
        rf"[{SURNAMES}{''.join(sorted({c[0] for c in COMPOUND}))}](?:(?<![{HAN}].)|(?<=[{BEFORE_NAME}].)|(?={N}(?:[{HAN}]{N}){{1,3}}(?:[^{HAN}\n]|[{AFTER_NAME}]|\Z)))(?={N}[{HAN}])", re.S
    ),
    "name_en": re.compile(rf"[A-Z](?<![A-Za-z].)(?:[a-z]{{1,11}}|[A-Z]?\.)(?:[-­]\n[a-z]+)?{SP}(?:[A-Z]\.?{SP})?[A-Z][a-z]+(?:['’-][A-Z]?[a-z]{{2,}})?(?:[-­‐]\n[a-z]+)?(?![A-Za-z])"),
}
#: What an address and an e-mail are looked for around: a street word before its number, an English house number, an at sign.
STREET_HINT = re.compile(rf"[路街巷同道]{N}[\d一二三四五六七八九十百千]|\d[A-Z]?{SP}[A-Z][a-z]")
AT_SIGN = re.compile(r"[@＠#]|[(\[（] ?at ?[)\]）]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.+-")
TO_PLACE = frozenset("寄住在至到往于址离为是给从地")
KINDS = ("email", "id_number", "phone", "address", "name")  # the earlier wins where spans overlap
#: What the labelers' reliabilities are estimated for: Chinese and Latin names are told by other votes.
GROUPS = ("email", "id_number", "phone", "address", "name_zh", "name_en")
LABELERS = ("form", "gazetteer", "before", "after", "counter", "place", "learned")
# Assumed shares of the votes -1, 0, 1 on true and false spans, for labelers that speak for and for those against;
# they count as PRIOR spans beside those of the data.
EXPECTED = {(1, 0): (0.05, 0.15, 0.8), (0, 0): (0.5, 0.3, 0.2), (1, 1): (0.02, 0.97, 0.01), (0, 1): (0.5, 0.49, 0.01)}
AGAINST_ONLY = (4, 5)
PRIOR = 20.0
CUES = {  # words before a span that speak for it
    "email": re.compile(r"(?:邮箱|邮件|电邮|发[到至给]|抄送|回复|e-?mail|cc|to|at|[/:：;；，,。、(（])\s*[:：]?\s*$", re.I),
    "phone": re.compile(r"(?:电话|手机|号码|致电|拨打|打|联系方式|传真|tel|phone|mobile|call|on|from|by|[/:：;；，,。、.(（+]|^)\s*[:：]?\s*$", re.I),
    "id_number": re.compile(r"(?:证号?|号码|证件|护照|身份|id|passport|document|number|against|[/:：;；，,。、(（)）]|\d\s)\s*[:：]?\s*$", re.I),
    "address": re.compile(r"(?:址|住|寄|在|至|到|往|于|离|地|lives at|at|to|of|from|[/:：;；，,。、(（.]|^)\s*[:：]?\s*$", re.I),
    "name_zh": re.compile(r"(?:姓名|户名|户主|本人|签字|签名|签章|经办|联系人|收件人|寄件人|代理人|负责人|经手人|买受人|出卖人|申请人|承租人|持有人|见证人|证明人|业主)[)）]?[:：]?\s*$"),
    "name_en": re.compile(r"(?:\b(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.?|[Ss]igned by|[Ss]poke to|[Aa]sk for|[Cc]ontact|[Nn]ame|[Hh]older|[Aa]ttn|[Ww]itness(?:ed by)?|[Dd]ear)[:：]?\s*$"),
}
AFTER = {
    "email": re.compile(r"^\s*(?:[，,。;；.、)）]|$)"),
    "phone": re.compile(r"^\s*(?:[，,。;；./、)）]|$)"),
    "id_number": re.compile(r"^\s*(?:[，,。;；.、)）]|$)"),
    "address": re.compile(r"^\s*(?:[，,。;；.、)）]|$|[a-z])"),
}
TITLED = re.compile(r"^\s*(?:先生|女士|小姐|同志|老师|[:：,，、；;。.)）/”]|$)")
COMPANY = re.compile(r"^\s*(?:Co\b|Ltd|Limited|Holdings|Trading|Inc|plc|LLP|公司|集团|有限)")
PLACE = re.compile(r"^[\u200b-\u200f\u2060\ufeff\xad]*(?:某|[路街巷苑府湾阁庄村镇乡县区市省厦楼园]|花园|公馆|大道|胡同|广场|小区|大厦)")
AGAINST = re.compile(r"(?:账号|账户|订单号?|单号|流水号|发票号码|发票号|合同编号|编号|回执|receipt|ref|reference|代码：?|invoice|order|account|account no\.?|quoting|票号|版本)\s*[：:#]?\s*$")


#: The last characters of what AGAINST and the cues of Chinese names match: others need no look.
LAST_OF_CUES = frozenset("号户单执码本名主人字章办：:#)） \u3000") | frozenset("tfecrgn.")


def reduce_item(text: str) -> str:
    return re.sub("[^A-Za-z0-9一-鿿]", "", text).lower()


_BREAK = re.compile(r"(?<=([\u3000-\u9fff\uff00-\uffef]))\s*\n\s*|\s*\n\s*(?=([\u3000-\u9fff\uff00-\uffef]))|\s*\n\s*")


def unbroken(text: str) -> str:
    """Context without line breaks: nothing next to a Han character, else a blank."""
    return _BREAK.sub(lambda m: "" if m.group(1) or m.group(2) else " ", text) if "\n" in text else text


def votes_of(kind: str, span: str, before: str, after: str) -> list[int]:
    """The labelers' votes on one span with its contexts; what needs counts (names' ``learned``) is 0 here."""
    item = re.sub(r"\s", "", span)
    form = gazetteer = place = 0
    if kind == "email":
        form = 1 if re.search(r"[A-Za-z]{2,}$", item) and len(item) > 7 else -1
        gazetteer = 1 if re.search(r"(?:example|test|invalid|com|org|net|cn|edu|gov|uk)$", item, re.I) else -1
    elif kind == "phone":
        digits = re.sub(r"\D", "", item)
        form = 1 if 9 <= len(digits) <= 17 else -1
        gazetteer = 1 if re.match(r"(?:86)?1[3-9]\d|0|1?\d{3}[2-9]\d{6}|44|(?:86)?0", digits) else -1
        place = -1 if len(set(digits)) < 3 else 0
    elif kind == "id_number":
        m = re.search(r"\d{6}-?((?:19|20)\d\d)(\d\d)(\d\d)-?\d{3}[\dXx]$", item)
        form = (1 if 1 <= int(m.group(2)) <= 12 and 1 <= int(m.group(3)) <= 31 else -1) if m else (1 if re.match(r"\d{3}-\d\d-\d{4}$|[A-Z]{2}\d{6}[A-D]$|[A-Z]{1,2}\d{7}", item) else -1)
        gazetteer = 1 if m or re.match(r"[A-Z]{2}\d{6}[A-D]$", item) else 0
    elif kind == "address":
        form = 1 if re.search(r"[号室弄楼层元\d]$|[a-z.]$", item) else -1
        gazetteer = 1 if re.search(r"路|街|巷|大道|胡同|" + STREET_EN, item) else -1
    else:
        first, *_, last = re.split(r"\s+", re.sub(r"[-­‐]\n", "", span))
        form = 0 if "." in first else 1
        gazetteer = 1 if first in GIVEN_NAMES else 0
        if last.lower() in ENGLISH_LINE_OF or COMPANY.match(after) or re.fullmatch(STREET_EN, last):
            place = -1
    against = -1 if AGAINST.search(before) else 0
    left = 1 if CUES[kind].search(before) and not against else 0
    right = 1 if (AFTER[kind] if kind in AFTER else TITLED).search(after) else 0
    return [form, gazetteer, left, right, against, place, 0]


def addresses(text: str) -> list[tuple[int, int]]:
    """Address spans around each hint, as far as they go to both sides.

    An address begins after a sign or a word that sends there; where none stands before it, the names of its places have
    two characters each."""
    out, at = [], 0
    for h in STREET_HINT.finditer(text):
        if h.start() < at:
            continue
        found = None
        if text[h.start()].isdigit():
            lo = h.start()
            while lo > at and text[lo - 1].isdigit():
                lo -= 1
            flat = re.search(r"(?:Flat|Unit|Apt|Apartment|Suite)[ \n]\d+[A-Z]?,[ \n]$", text[max(at, lo - 24) : lo])
            m = PATTERNS["address_en"].match(text, max(at, lo - 24) + flat.start() if flat else lo)
            found = m.span() if m and m.end() > h.start() else None
        else:
            options = []
            p = h.start()
            floor = max(at, p - 48)
            while p > floor and ("一" <= text[p - 1] <= "鿿" or text[p - 1] == "\n"):
                p -= 1
                if text[p] == "\n":
                    continue
                left = text[p - 2] if p > 1 and text[p - 1] == "\n" else text[p - 1] if p else ""
                m = PATTERNS["address_zh"].match(text, p)
                if m and h.start() < m.end():
                    parts = [len(g.replace("\n", "")) for g in m.groups() if g]
                    starts = not "一" <= left <= "鿿" or (text[p - 1] == "\n" and all(x == 2 for x in parts))
                    sent = left in TO_PLACE
                    two = all(x == 2 for x in parts)
                    if starts or sent or two:
                        options.append(((sent or starts) and two, (sent or starts) and min(parts) >= 2, two, h.start() - p, m.span()))
            found = max(options)[4] if options else None
        if found:
            out.append(found)
            at = found[1]
    return out


def emails(text: str) -> list[tuple[int, int]]:
    """E-mail spans: from each at sign back over the local part, then matched forward."""
    out, at = [], 0
    for h in AT_SIGN.finditer(text):
        p = h.start()
        if p and text[p - 1] == " ":
            p -= 1
        while p > at and text[p - 1] in LOCAL:
            p -= 1
        while p < h.start() and text[p] in "_.+-":
            p += 1
        m = PATTERNS["email"].match(text, p) if p < h.start() and p >= at else None
        if m and m.end() > h.end():
            out.append(m.span())
            at = m.end()
    return out


#: Places of the table of each role; characters have a place of their own, words and surnames a hashed one.
PLACES = 1 << 16
NOWHERE = [0] * 6  # place 0 stands for none
ROLES = ("given", "before", "after", "surname", "first", "last", "word before", "word after")


@cache
def place_of(role: str, word: str) -> int:
    """The place of a character or word in the tables: there are ``PLACES`` for each role, whatever the texts."""
    at = ord(word) if len(word) == 1 and ord(word) < PLACES else zlib.crc32(word.encode("utf-8", "surrogatepass")) % PLACES
    return ROLES.index(role) * PLACES + at


def chinese_names(text: str, taken: list[tuple[int, int]]) -> list[tuple]:
    """Every possible Chinese name outside ``taken`` as (kind, from, to, item, votes, places, shape).

    The places are those of the given characters, of the next one as such, of what stands before and after, of the
    surname.  A span needs something at its left or right that may stand there."""
    out = []
    k = 0
    for m in PATTERNS["name_zh"].finditer(text):
        a = m.start()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] <= a:
            continue
        run = text[a : a + 12].replace("\n", "")
        first = 2 if run[:2] in COMPOUND else 1
        before = text[a - 1 : a] if text[a - 1 : a] != "\n" else text[max(0, a - 2) : a - 1]
        if first == 1 and (run[0] not in SINGLE or before + run[0] in COMPOUND):
            continue
        close = not "一" <= before <= "鿿"
        left = close or before in _BEFORE
        counter = cue = None
        for n in (1, 2):
            given, after = run[first : first + n], run[first + n : first + n + 3]
            if len(given) < n or not "一" <= given[-1] <= "鿿":
                break
            next_ = after[:1]
            ends = not "一" <= next_ <= "鿿"
            if not (left or ends or next_ in _AFTER):
                continue
            if cue is None:
                counter = cue = 0
                if before in LAST_OF_CUES:
                    context = unbroken(text[max(0, a - 24) : a])[-14:]
                    counter = -1 if AGAINST.search(context) else 0
                    cue = 1 if not counter and CUES["name_zh"].search(context) else 0
            size = first + n
            end = a + size
            while end - a - text.count("\n", a, end) < size:
                end += 1
            broken = end - a - size
            place = -1 if PLACE.match(after) or COMPANY.match(after) or "某" in given or next_ == "*" else 0
            titled = 1 if TITLED.search(after) else 0
            votes = [1 if n == 2 or first == 2 else 0, 0, cue, titled, counter, place, 0]
            places = [place_of("given", given[0]), place_of("given", given[1]) if n == 2 else 0, place_of("given", next_), place_of("before", "." if close else before), place_of("after", "." if ends else next_), place_of("surname", run[:first])]
            out.append(("name_zh", a, end, run[:size], votes, places, [size / 40, 0.0, 1.0, broken / (end - a)]))
    return out


def latin_names(text: str, taken: list[tuple[int, int]]) -> list[tuple]:
    """Every possible Latin name outside ``taken``; places: of the first and last word, of what stands before and after."""
    out = []
    at = 0
    while m := PATTERNS["name_en"].search(text, at):
        a, b = m.span()
        words = re.sub(r"[-­‐]\n", "", m.group()).split()
        at = a + len(words[0])  # the next word may be the given name
        if any(x < b and y > a for x, y in taken):
            continue
        left = re.search(r"([A-Za-z]+|\S|^)\s*$", text[max(0, a - 16) : a])
        right = re.match(r"\s*([A-Za-z]+|\S|$)", text[b : b + 16])
        votes = votes_of("name_en", m.group(), unbroken(text[max(0, a - 24) : a])[-14:], unbroken(text[b : b + 20])[:12])
        places = [place_of("first", words[0]), place_of("last", words[-1]), place_of("word before", left.group(1)[-12:] if left else ""), place_of("word after", right.group(1)[:12] if right else ""), 0, 0]
        out.append(("name_en", a, b, reduce_item(m.group()), votes, places, shape_of(m.group())))
    return out


SINGLE, _BEFORE, _AFTER = frozenset(SURNAMES), frozenset(BEFORE_NAME), frozenset(AFTER_NAME)
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("item", pa.string()), ("votes", pa.list_(pa.int8())), ("places", pa.list_(pa.int32())), ("shape", pa.list_(pa.float32()))]))
SPANS_VOTED = pa.list_(pa.struct([*list(SPANS.value_type)[:4], ("votes", pa.int32()), ("shape", pa.list_(pa.float32()))]))
SPANS_ACCEPTED = pa.list_(pa.struct(list(SPANS.value_type)[:4]))
VOTED = "array<struct<kind:string,a:int,b:int,item:string,votes:int,shape:array<float>>>"
ACCEPTED = "array<struct<kind:string,a:int,b:int,item:string>>"


def listed(rows: list[list[tuple]], kind: pa.ListType) -> pa.ListArray:
    """Lists of tuples as an Arrow array of lists of structs, column by column."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    fields = list(kind.value_type)
    columns = list(zip(*(x for r in rows for x in r))) or [()] * len(fields)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields))


def ends_of(column: pa.ListArray) -> np.ndarray:
    """Where each row's part of the flattened column ends."""
    return np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))


def as_list(flat: pa.StructArray, rows: np.ndarray, keep: np.ndarray, columns: dict, kind: pa.ListType, n: int) -> pa.ListArray:
    """The kept spans (indices, ordered by row) with some columns replaced, as lists by row."""
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(rows[keep], minlength=n), out=offsets[1:])
    fields = list(kind.value_type)
    arrays = [columns[f.name] if f.name in columns else flat.field(f.name).take(pa.array(keep)) for f in fields]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, fields)], fields=fields))


def propose(texts: list[str]) -> list[list[tuple]]:
    """The possible spans of each text as (kind, from, to, item, votes, places, shape)."""
    memo: dict = {}
    out = []
    for t in texts:
        if t in memo:
            out.append(memo[t])
            continue
        found = [("email", a, b) for a, b in emails(t)] + [("address", a, b) for a, b in addresses(t)]
        found += [(k, *m.span()) for k in ("id_number", "phone") for m in PATTERNS[k].finditer(t)]
        rows = []
        for kind, a, b in found:
            span = t[a:b]
            rows.append((kind, a, b, reduce_item(span), votes_of(kind, span, unbroken(t[max(0, a - 24) : a])[-14:], unbroken(t[b : b + 20])[:12]), NOWHERE, shape_of(span)))
        taken = sorted((a, b) for _, a, b in found)
        rows += chinese_names(t, taken) + latin_names(t, taken)
        memo[t] = rows
        out.append(memo[t])
    return out


def proposed(text: Column | str) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return listed(propose(texts.to_pylist()), SPANS)

    return F.arrow_udf(run, "array<struct<kind:string,a:int,b:int,item:string,votes:array<tinyint>,places:array<int>,shape:array<float>>>").asNondeterministic()(text)  # run once, not again in a filter


def shape_of(span: str) -> list[float]:
    n = max(1, len(span))
    return [min(n, 40) / 40, sum(c.isdigit() for c in span) / n, sum("一" <= c <= "鿿" for c in span) / n, span.count("\n") / n]


def log_odds(seen: dict[int, tuple[int, int]]) -> dict[int, float]:
    """For each place, how much commoner it is in the chosen spans than in all, from (all, chosen) counts; smoothed by
    one chosen span, so that a rare one says little."""
    everything, chosen = sum(n for n, _ in seen.values()) + 1.0, sum(k for _, k in seen.values()) + 1.0
    share = chosen / everything
    return {p: math.log((k + 1) / (n + 1 / share) / share) for p, (n, k) in seen.items()}


def contended(row: list[int], start: list[int], end: list[int], name: list[bool], sums: list[int]) -> list[int]:
    """Of names that overlap, the one with the better votes, then the longer: what a place can hold but once counts once.

    All lists are ordered by row and start; returns the indices that stay."""
    kept: list[int] = []
    for i in range(len(row)):
        if kept and name[i]:
            k = kept[-1]
            if name[k] and row[k] == row[i] and start[i] < end[k]:
                if (sums[i], end[i] - start[i]) > (sums[k], end[k] - start[k]):
                    kept[-1] = i
                continue
        kept.append(i)
    return kept


def learned_votes(zh: np.ndarray, name: np.ndarray, votes: np.ndarray, odds: np.ndarray, margin: float = 0.7) -> np.ndarray:
    """Votes (n x labelers) of spans with what the counts say: ``odds`` (n x 6) of a name's characters or words and of what
    stands beside it; other spans' votes stay."""
    one, two, next_, left, right, surname = odds.T
    single = zh & (two == 0)
    least = np.where(single, one, np.minimum(one, two))
    made = np.where(least < 0, least, np.where(single, one, (one + two) / 2) + np.minimum(0, surname) / 2)
    made = np.where(zh, made, one + np.minimum(0, two))
    left, right = np.where(zh, left, next_), np.where(zh, right, left)
    on = single & (next_ > margin)  # the given name goes on
    sign = lambda x: (x > margin).astype(np.int8) - (x < -margin)
    votes = votes.copy()
    votes[name, 6] = sign(made)[name]
    votes[name, 2] = np.where(votes[:, 2] != 0, votes[:, 2], sign(left))[name]
    votes[name, 3] = np.where(on, -1, np.where(votes[:, 3] != 0, votes[:, 3], sign(right)))[name]
    return votes


POWERS = 3 ** np.arange(len(LABELERS))


def pattern(votes: np.ndarray) -> np.ndarray:
    """Votes as one number a span."""
    return ((votes.astype(np.int64) + 1) * POWERS).sum(1)


def unpattern(n: int) -> str:
    return ",".join(str(n // int(p) % 3 - 1) for p in POWERS)


def recounted(flat: pa.StructArray, table_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a Chinese name, whether a name, votes) of spans with the learned votes filled in."""
    kinds = flat.field("kind")
    zh = pc.equal(kinds, "name_zh").to_numpy(zero_copy_only=False)
    name = zh | pc.equal(kinds, "name_en").to_numpy(zero_copy_only=False)
    votes = flat.field("votes").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(LABELERS))
    places = flat.field("places").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NOWHERE))
    return zh, name, learned_votes(zh, name, votes, table_[places])


def table_of(odds: dict[int, float]) -> np.ndarray:
    out = np.zeros(len(ROLES) * PLACES, np.float32)
    for p, x in odds.items():
        out[p] = x if p else 0.0
    return out


def voted(odds: dict[int, float]):
    """Proposed spans -> the same with the learned votes filled in, overlapping names contended."""
    built: dict = {}

    def run(column: pa.Array) -> pa.Array:
        if not built:
            built["t"] = table_of(odds)
        flat = column.flatten()
        row = np.searchsorted(ends_of(column), np.arange(len(flat)), "right")
        a, b = flat.field("a").to_numpy(), flat.field("b").to_numpy()
        order = np.lexsort((b, a, row))
        _, name, votes = recounted(flat, built["t"])
        kept = order[contended(row[order].tolist(), a[order].tolist(), b[order].tolist(), name[order].tolist(), votes[order].sum(1).tolist())]
        return as_list(flat, row, kept, {"votes": pa.array(pattern(votes)[kept])}, SPANS_VOTED, len(column))

    return F.arrow_udf(run, VOTED)


def estimate(counts: list[tuple[str, str, int]], rounds: int = 30) -> tuple[dict, dict]:
    """EM per kind from the counts of vote patterns: (log odds that each labeler's votes -1, 0, 1 and the share of true
    spans give, probability of each vote pattern)."""
    reliability, posterior = {}, {}
    by = defaultdict(list)
    for kind, votes, n in counts:
        by[kind].append((tuple(map(int, votes.split(","))), n))
    for kind, rows in by.items():
        v = np.array([r[0] for r in rows])
        n = np.array([r[1] for r in rows], float)
        against = [int(j in AGAINST_ONLY) for j in range(v.shape[1])]
        p = 1 / (1 + np.exp(-1.2 * (v * np.where(against, 4.0, 1.0)).sum(1)))
        for _ in range(rounds):
            prior = np.clip((n * p).sum() / n.sum(), 0.02, 0.98)
            shares = PRIOR * np.array([[EXPECTED[c, against[j]] for j in range(v.shape[1])] for c in (0, 1)])
            for c, q in ((1, p), (0, 1 - p)):
                for k in (-1, 0, 1):
                    shares[c, :, k + 1] += ((v == k) * (n * q)[:, None]).sum(0)
            shares /= shares.sum(2, keepdims=True)
            odds = np.log(shares[1] / shares[0])
            logit = np.log(prior / (1 - prior)) + sum(odds[j, v[:, j] + 1] for j in range(v.shape[1]))
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        reliability[kind] = (odds, float(np.log(prior / (1 - prior))))
        posterior.update({(kind, ",".join(map(str, r))): float(q) for r, q in zip(v.tolist(), p)})
    return reliability, posterior


WIDTH = 3 * len(LABELERS) + 1


def features(kind: str, votes: str, shape: list[float]) -> list[float]:
    x = [0.0] * (len(GROUPS) * WIDTH) + list(shape) + [1.0]
    base = GROUPS.index(kind) * WIDTH
    for j, v in enumerate(map(int, votes.split(","))):
        x[base + 3 * j + v + 1] = 1.0
    x[base + WIDTH - 1] = 1.0
    return x


def train(sample: list[tuple[str, str, list[float]]], reliability: dict, posterior: dict, rounds: int = 200) -> np.ndarray:
    """Logistic regression by full-batch gradient steps on soft labels, from the labelers' reliabilities as first weights;
    rare vote patterns weigh as the root of their number."""
    x = np.array([features(*s) for s in sample])
    y = np.array([posterior[s[0], s[1]] for s in sample])
    seen = Counter((k, v) for k, v, _ in sample)
    weight = np.array([seen[k, v] ** -0.5 for k, v, _ in sample])
    weight *= len(weight) / weight.sum()
    w = np.zeros(x.shape[1])
    for kind, (odds, prior) in reliability.items():
        base = GROUPS.index(kind) * WIDTH
        w[base : base + WIDTH - 1], w[base + WIDTH - 1] = odds.ravel(), prior
    first = w.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (weight * (p - y)) / len(y) + 1e-4 * (w - first))
    return w


def decide(w: list[float]):
    """Spans with votes -> accepted spans without overlaps, by kind and then by how sure they are."""

    def run(column: pa.Array) -> pa.Array:
        weights, flat = np.array(w), column.flatten()
        row = np.searchsorted(ends_of(column), np.arange(len(flat)), "right")
        kinds = flat.field("kind").to_pylist()
        group = np.array([GROUPS.index(k) for k in kinds], np.int64)
        codes, which = np.unique(group * 3 ** len(LABELERS) + flat.field("votes").to_numpy(), return_inverse=True)
        known = np.array([np.dot(features(GROUPS[c // 3 ** len(LABELERS)], unpattern(c % 3 ** len(LABELERS)), [0.0] * 4), weights) for c in codes.tolist()])
        shapes = flat.field("shape").flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        score = (known[which] if len(codes) else np.zeros(0)) + shapes @ weights[-5:-1]
        a, b = flat.field("a").to_numpy(), flat.field("b").to_numpy()
        rank = np.minimum(group, KINDS.index("name"))
        good = np.flatnonzero(score > 0)
        good = good[np.lexsort((-b[good], a[good], -np.round(score[good], 6), rank[good], row[good]))]
        kept: list[int] = []
        mine: list[tuple[int, int]] = []
        at = -1
        for i, r, x, y in zip(good.tolist(), row[good].tolist(), a[good].tolist(), b[good].tolist()):
            if r != at:
                at, mine = r, []
            if all(y <= p or x >= q for p, q in mine):
                mine.append((x, y))
                kept.append(i)
        keep = np.array(kept, np.int64)
        keep = keep[np.lexsort((a[keep], row[keep]))]
        return as_list(flat, row, keep, {"kind": pa.array([kinds[i].removesuffix("_zh").removesuffix("_en") for i in keep.tolist()], pa.string())}, SPANS_ACCEPTED, len(column))

    return F.arrow_udf(run, ACCEPTED)


def learned(held: DataFrame) -> dict[int, float]:
    """Log odds of every place of the hashed tables: what names are made of and stand between.

    First the parts of names are counted in spans that a role word introduces and a sign or title ends, against all spans;
    then what stands beside names in spans made of such parts.  At most ``PLACES`` rows a role come to the driver."""
    spans = held.select(F.explode(F.filter("proposed", lambda s: s["kind"].startswith("name"))).alias("s")).select("s.kind", "s.votes", "s.places")
    zh, at = F.col("kind") == "name_zh", lambda *k: F.array(*[F.col("places")[i] for i in k])
    parts, beside = F.when(zh, at(0, 1, 5)).otherwise(at(0, 1)), F.when(zh, at(3, 4)).otherwise(at(2, 3))
    vote = lambda k: F.col("votes")[k]
    seed = (vote(2) > 0) & (vote(3) > 0) & (vote(4) == 0) & (vote(5) == 0)

    def odds(of: Column, chosen: Column) -> dict[int, float]:
        counted = spans.select("kind", chosen.alias("chosen"), F.explode(of).alias("place")).where("place <> 0").groupBy("kind", "place").agg(F.count("*").alias("n"), F.count_if("chosen").alias("k"))
        by = defaultdict(dict)
        for r in counted.collect():  # at most PLACES a role
            by[r.kind][r.place] = (r.n, r.k)
        return {p: x for seen in by.values() for p, x in log_odds(seen).items()}

    first = odds(parts, seed)
    return first | odds(beside, seed | made_of(first)("kind", "votes", "places"))


def made_of(odds: dict[int, float]):
    """Whether a span is made of what names are made of, and ends where the given name does."""
    built: dict = {}

    def run(kinds: pa.Array, votes: pa.Array, places: pa.Array) -> pa.Array:
        if not built:
            built["t"] = table_of(odds)
        _, _, v = recounted(pa.StructArray.from_arrays([kinds, votes, places], names=["kind", "votes", "places"]), built["t"])
        return pa.array((v[:, 6] > 0) & (v[:, 3] >= 0))

    return F.arrow_udf(run, "boolean")


def find_personal(rows: DataFrame, text: str = "text", sample_spans: int = 20_000, keep_text: bool = True) -> DataFrame:
    """``rows`` with ``spans``: the personal items of each text.  Only rows with a proposed span are kept.

    ``sample_spans`` bounds the spans the classifier is trained on, taken in the order of a hash of all of them."""
    kept = [c for c in rows.columns if keep_text or c != text]
    held = materialise(spread(rows).withColumn("proposed", proposed(text)).where("size(proposed) > 0").select(*kept, "proposed"), "spans")
    held = materialise(held.withColumn("proposed", voted(learned(held))("proposed")), "votes")
    each = held.select(F.explode("proposed").alias("s")).select("s.kind", "s.votes", "s.shape", "s.item")
    counts = [(r[0], unpattern(r[1]), r[2]) for r in each.groupBy("kind", "votes").count().collect()]  # bounded: 3 votes, 7 labelers, 6 kinds
    if not counts:
        return held.select(*kept, F.lit(None).cast(ACCEPTED).alias("spans")).limit(0)
    reliability, posterior = estimate(counts)
    sample = each.orderBy(F.xxhash64("item", "votes"), "item", "votes").limit(sample_spans).select("kind", "votes", "shape").collect()
    w = train([(r.kind, unpattern(r.votes), list(r.shape)) for r in sample], reliability, posterior)
    return held.withColumn("spans", decide(w.tolist())("proposed")).select(*kept, "spans")


@vectorised("string")
def replaced(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, found in zip(texts, spans):
        parts, at = [], 0
        for s in found if found is not None else ():
            parts += [t[at : s["a"]], f"[{s['kind'].upper()}]"]
            at = s["b"]
        out.append("".join(parts) + t[at:])
    return pd.Series(out)


FIELDS = (("pipeline_outputs", "doc_id", "raw_text"), ("completeness_issues", "id", "evidence"), ("obligations", "id", "evidence"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, t).select(F.lit(f"{t}.{c}").alias("field_name"), F.col(i).alias("row_id"), F.col(c).alias("text")).where("text is not null") for t, i, c in FIELDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each different personal item of a row."""
    found = find_personal(texts(spark, folder), keep_text=False)
    return found.select("field_name", "row_id", F.explode("spans").alias("s")).select("field_name", "row_id", "s.kind", "s.item").where("item <> ''").distinct()


def p6_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with personal items replaced by placeholders; texts without any are unchanged and not listed."""
    return find_personal(texts(spark, folder)).where("size(spans) > 0").select("field_name", "row_id", replaced("text", "spans").alias("text")).distinct()
