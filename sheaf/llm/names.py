"""Linking spellings of one company or person by canonical rewriting and equi-join.

Every name is rewritten by rules (roles and seals' remarks off, nicknames, initials, legal forms, order of parts,
traditional characters, usual abbreviations of a line of business) into keys; keys are exploded into forms, the
forms are equi-joined, and a rewriting is scored by its rarity, one over the number of entities its forms fit: a nickname
is rewritten to every full name it may stand for, and links where only one of them is an entity of that surname.
A misspelt key joins the better supported key that shares a one-edit form with it.  Groups are aggregated to one
root per form, so no stage emits pairs before the last, whose pairs are the result.  Every join is a sort-merge join
(`merged`), so the driver holds no part of a table at any size.

Edge cases: null and blank names give no row; a name that nothing else resembles gives no pair; repeated rows count
as support but give no further pairs; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.script import plain
from sheaf.functions.vectorised import vectorised
from sheaf.sources.tables import materialise, table

# Lines of business and their usual short or equivalent forms.
LINES = {
    "餐饮管理": "餐饮 餐饮服务", "物业服务": "物业 物业管理 物管", "信息技术": "信息 信息科技", "融资租赁": "租赁 融租", "医疗器械": "医械 医疗",
    "文化传媒": "传媒 文化 文传", "环保设备": "环保", "建筑工程": "建工 建筑", "农业发展": "农业 农发", "物流": "货运 物流运输", "贸易": "商贸 经贸",
    "置业": "房地产 地产", "新能源": "能源", "科技": "", "纺织": "织造 纺织品",
}
LINE_OF = {plain(w): k for k, v in LINES.items() for w in (k, *v.split())}
ENGLISH_LINES = {
    "engineering": "engg engrg eng engr", "holdings": "hldgs hldg holding", "trading": "trdg trd", "textiles": "text textile txtl", "logistics": "logs log logis",
    "property": "prop propty", "services": "svcs svc serv service", "insurance": "ins insur", "brokers": "brkrs bkrs broker brks", "technology": "tech technologies", "management": "mgmt mgt",
    "international": "intl", "manufacturing": "mfg", "industries": "inds ind", "development": "dev", "consulting": "cons", "equipment": "equip", "construction": "constr",
}
ENGLISH_LINE_OF = {w: k for k, v in ENGLISH_LINES.items() for w in (k, *v.split())}
# Nicknames of given names.
NICKNAMES = {
    "alexandra": "sandra alex lexi", "alexander": "alex sandy xander", "patrick": "pat paddy", "anthony": "tony", "charlotte": "lottie charlie", "dorothy": "dot dottie dolly", "edward": "ted ed eddie ned", "elizabeth": "liz beth betty lizzie eliza",
    "frederick": "fred freddie", "joseph": "joe joey", "katherine": "kate kathy katie kit", "margaret": "peggy maggie meg greta", "michael": "mick mike mickey", "patricia": "trish pat patty tricia",
    "rebecca": "becky becca", "richard": "dick rick rich richie", "robert": "bob rob bobby robbie bert", "susannah": "sue susan susie", "theodore": "theo teddy", "thomas": "tom tommy",
    "william": "bill will billy willy", "james": "jim jimmy jamie", "john": "jack johnny", "henry": "harry hank", "charles": "charlie chuck", "francis": "frank", "george": "georgie", "andrew": "andy drew",
    "nicholas": "nick", "samuel": "sam", "daniel": "dan danny", "matthew": "matt", "christopher": "chris kit", "benjamin": "ben", "stephen": "steve", "catherine": "cathy cate", "victoria": "vicky tori",
    "jennifer": "jenny jen", "barbara": "barb babs", "deborah": "deb debbie", "judith": "judy", "eleanor": "nell ellie nora", "abigail": "abby", "josephine": "josie jo", "philip": "phil", "walter": "wally walt",
}
#: Every full name a given name may stand for.
GIVEN_OF: dict[str, tuple[str, ...]] = {}
for _full, _short in NICKNAMES.items():
    for _w in (_full, *_short.split()):
        GIVEN_OF[_w] = tuple(dict.fromkeys((*GIVEN_OF.get(_w, ()), _full)))
# Compound surnames.
COMPOUND = set("欧阳 司马 上官 诸葛 东方 皇甫 尉迟 公孙 慕容 司徒 司空 令狐 宇文 长孙 闻人 澹台 濮阳 淳于 申屠 太叔 钟离 轩辕 夏侯 端木 百里 呼延 南宫 第五 梁丘 西门 闾丘 独孤 公羊 赫连 鲜于 拓跋 东郭 宗政 左丘".split())
ROLE = re.compile(r"^(?:甲方|乙方|丙方|丁方|出卖人|买受人|出让方|受让方|转让方|出租方|承租方|出租人|承租人|委托方|受托方|单位名称|公司名称|单位|名称|公司|姓名|买方|卖方|供方|需方|投保人|被保险人|受让人|转让人|经办人|代理人)\s*[:：\s]\s*")
REMARK = re.compile(r"\((?:以下简称.{1,6}|盖章|公章|章|签字|签章|签名|本人|甲方|乙方|丙方|印|代)\)$")
TITLE = re.compile(r"(?:先生|女士|小姐|同志|老师|经理)$")
LEGAL = re.compile(r"\(?(?:股份)?(?:有限责任公司|有限公司|有限责任|有限公|有限|公司)\)?$")
CITY_PAREN = re.compile(r"\(([㐀-鿿]{2,3}?)市?\)")
ENGLISH_LEGAL = {"co", "ltd", "limited", "company", "inc", "corp", "corporation", "llc", "plc"}
ENGLISH_TITLE = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir"}
HAN = re.compile("[㐀-鿿]")


def collapse(text: str) -> str:
    """Neighbouring repeats of a letter or character once."""
    return re.sub(r"(.)\1+", r"\1", text)


def bare(name: str) -> str:
    """Plain characters without role before and remarks or stops after the name."""
    text = plain(name).replace("　", " ").strip()
    text = ROLE.sub("", text)
    while True:
        cut = REMARK.sub("", text.rstrip(" 。.;；,，、"))
        if cut == text:
            return text
        text = cut


def company(text: str) -> tuple[str, str, str, str] | None:
    """(kind, stem, line, city) of a Chinese company name, or None."""
    text = re.sub(r"\s+", "", text)
    city = ""
    had_legal = False
    for _ in range(3):
        for m in CITY_PAREN.finditer(text):
            if not LEGAL.fullmatch(m.group(0)):
                city, text = m.group(1), text[: m.start()] + text[m.end() :]
                break
        cut = LEGAL.sub("", text)
        had_legal |= cut != text
        text = cut
    m = re.match(r"^(..)市(.+)$", text)
    if m:
        city, text = m.groups()
    line = ""
    for n in range(min(6, len(text) - 3), 1, -1):
        if text[-n:] in LINE_OF:
            line, text = LINE_OF[text[-n:]], text[:-n]
            break
    if not line and not had_legal and not city and len(text) != 4:
        return None
    stem = collapse(text)
    if not city and len(text) >= 6 and (len(text) == 6 or len(stem) >= 5):
        city, text = text[:2], text[2:]
        stem = collapse(text)
    if not line and len(text) > 5:
        line, stem = text[4:], collapse(text[:4])
    if not line and not had_legal and text[:2] in COMPOUND:
        return None
    return ("c", stem, line, city) if len(text) >= 2 else None


def chinese_person(text: str) -> str:
    """A person's name without title and spaces, surname first."""
    text = TITLE.sub("", text.strip())
    parts = text.split()
    if len(parts) == 2 and parts[1] in COMPOUND and parts[0] not in COMPOUND:
        parts.reverse()
    return "".join(parts)


def english(text: str) -> tuple[str, str, str, str] | None:
    """(kind, stem or surname, line or given name, initial) of a name in Latin letters."""
    text = re.sub(r"^m/s\.?\s+", "", text)
    inner = re.search(r"\(([a-z ]+)\)", text)
    if inner:
        text = inner.group(1) + " " + text[: inner.start()] + text[inner.end() :]
    comma = re.match(r"^([a-z'\-]+),\s*([a-z'\-]+\.?)((?:\s+[a-z]\.?)?)$", text)
    words = re.findall(r"[a-z][a-z'\-]*", text)
    if not words:
        return None
    if words[0] == "the":
        words = words[1:]
    legal = [w for w in words if w in ENGLISH_LEGAL]
    if not (comma and not legal):
        rest = [w for w in words if w not in ENGLISH_LEGAL]
        lines = [ENGLISH_LINE_OF[w] for w in rest[1:] if w in ENGLISH_LINE_OF]
        if legal or (lines and rest):
            if not rest:
                return None
            return ("e", rest[0], " ".join(lines) or " ".join(rest[1:]), "")
    words = [w for w in words if w not in ENGLISH_TITLE]
    if comma:
        words = [comma.group(2).rstrip("."), *comma.group(3).replace(".", "").split(), comma.group(1)]
    if len(words) < 2:
        return ("n", words[0], "", "") if words else None
    if words[-1] in GIVEN_OF and words[0] not in GIVEN_OF and len(words[0]) > 1:
        words = [words[-1], *words[1:-1], words[0]]
    first = words[0]
    if len(first) < 2:
        return ("n", words[-1], "", first)
    return ("n", words[-1], "|".join(GIVEN_OF.get(first, (first,))), first[0])


def parse(name: str) -> tuple[str, str, str, str]:
    """(kind, main part, detail, city or initial); kind '' for a name without letters.  A detail of several readings has
    them all, with '|' between."""
    text = bare(name)
    if HAN.search(text):
        parts = TITLE.sub("", text).split()
        reordered = len(parts) == 2 and parts[1] in COMPOUND and len(parts[0]) <= 2
        found = None if reordered else company(text)
        if found:
            return found
        person = chinese_person(text)
        return ("p", person, "-", "") if person else ("", "", "", "")
    return english(text) or ("", "", "", "")


@vectorised("kind string, main string, detail string, extra string")
def parsed(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(x) for x in names], columns=["kind", "main", "detail", "extra"])


def one_edit_forms(kind: str, main: str) -> list[str]:
    """Forms that mains one edit apart share.

    A Chinese stem with one place open ('?') meets stems of another character there; a Latin one with two neighbours
    in alphabetical order ('{}') meets those with the two swapped, one with a place open ('~…?…') those of another letter
    there.  The other '~' forms, the main itself and the main with one
    place left out, meet where one main is the other with a place more; two mains that are both longer than what they
    share are two edits apart and must not meet there (``is_self`` tells)."""
    out = [main, "~" + main]
    if len(main) >= (3 if kind == "c" else 6) and kind in "cen":
        out += ["~" + main[:i] + main[i + 1 :] for i in range(len(main))]
        if kind == "c":
            out += [f"{main[:i]}?{main[i + 1 :]}" for i in range(len(main))]
        else:
            out += [f"{main[:i]}{{{''.join(sorted(main[i : i + 2]))}}}{main[i + 2 :]}" for i in range(len(main) - 1)]
            out += [f"~{main[:i]}?{main[i + 1 :]}" for i in range(len(main))]
    return list(dict.fromkeys(out))


@vectorised("array<string>")
def edit_forms(kinds: pd.Series, mains: pd.Series) -> pd.Series:
    return pd.Series([one_edit_forms(k, m) for k, m in zip(kinds, mains)])


def merged(df: DataFrame) -> DataFrame:
    """``df`` for a sort-merge join.  The planner takes exploded forms for as small as their keys, a tenth or less of what
    they are, and would broadcast them through the driver."""
    return df.hint("merge")


def link_names(names: DataFrame) -> DataFrame:
    """``names`` (name, n) to (name, entity): the entity of each spelling that has one.

    Keys complete in both parts are merged into the best supported key of the same detail that shares a one-edit
    form; incomplete keys (a stem alone, an initial) join the only complete key they fit, or each other if none."""
    known = materialise(names.select("name", "n", parsed("name").alias("k")).select("name", "n", "k.*").where("kind <> ''"), "names")
    several = F.col("detail").contains("|")
    readings = known.where("detail <> ''").select("kind", "main", F.explode(F.split("detail", "[|]")).alias("detail"), "extra", F.when(several, 0).otherwise(F.col("n")).alias("n"))
    # The commonest city or initial of a key, the smaller of equally common ones.
    extras = readings.groupBy("kind", "main", "detail", "extra").agg(F.sum("n").alias("n"))
    usual = F.min(F.when(F.col("extra") != "", F.struct(-F.col("n"), "extra")))["extra"]
    full = extras.groupBy("kind", "main", "detail").agg(F.sum("n").alias("support"), usual.alias("extra"))
    forms = full.select("*", F.explode(edit_forms("kind", "main")).alias("form"))
    rank = F.struct("support", "main")
    is_self = F.col("form") == F.concat(F.lit("~"), "main")
    best = forms.groupBy("kind", "detail", "form").agg(F.max(rank).alias("every"), F.max(F.when(is_self, rank)).alias("spelt"))
    # Of a '~' form a longer main can only join the main it spells, and that one the best of the longer ones; one place
    # more or less, or another letter, is common between names of their own: the root must have several times the support.
    other = F.when(is_self | F.col("form").contains("?"), F.col("every")).otherwise(F.col("spelt"))
    top = F.when(~F.col("form").startswith("~"), F.col("every")).when(other["support"] >= 3 * F.col("support"), other)
    roots = forms.join(merged(best), ["kind", "detail", "form"]).withColumn("top", top).groupBy("kind", "main", "detail").agg(F.max("top").alias("top"), F.min("extra").alias("extra"))
    roots = roots.select("kind", "main", "detail", F.col("top.main").alias("root"), F.col("top.support").alias("support"), "extra")
    # A root may itself lead to a better one: follow once more, so that chains of two spellings end in one root.
    again = roots.select("kind", F.col("main").alias("root"), "detail", F.col("root").alias("root2"), F.col("support").alias("support2"))
    roots = materialise(roots.join(merged(again), ["kind", "root", "detail"]).select("kind", "main", "detail", F.col("root2").alias("root"), F.col("support2").alias("support"), "extra"), "roots")
    # A name of one reading is its root's; one of several is scored by rarity: one over the entities that its readings fit.
    read = known.where("detail <> ''").select("name", "kind", "main", F.explode(F.split("detail", "[|]")).alias("detail"), F.col("detail").alias("readings"))
    read = read.join(merged(roots.drop("extra")), ["kind", "main", "detail"]).select("name", F.concat_ws("|", "kind", "root", "detail").alias("entity"), "support", F.concat_ws("|", "kind", "root", F.lit("?"), "readings").alias("own"))
    fits = F.when(F.col("support") > 0, F.col("entity"))
    complete = read.groupBy("name").agg(F.min(fits).alias("one"), F.max(fits).alias("other"), F.count(fits).alias("fit"), F.min("own").alias("own")).withColumn("rarity", F.when(F.col("fit") > 0, 1 / F.col("fit")))
    complete = complete.select("name", F.when((F.col("rarity") == 1) | (F.col("one") == F.col("other")), F.col("one")).otherwise(F.col("own")).alias("entity"))

    part = known.where("detail = ''")
    ends = roots.where("support > 0").select("kind", "main", "root", "detail", F.when(F.col("kind") == "n", F.substring("detail", 1, 1)).otherwise(F.coalesce("extra", F.lit(""))).alias("extra"))
    named = F.concat_ws("|", "kind", "root", "detail")
    keys = ends.select("kind", "main", F.explode(F.array_distinct(F.array("extra", F.lit("")))).alias("extra"), named.alias("entity"))
    keys = keys.groupBy("kind", "main", "extra").agg(F.min("entity").alias("entity"), F.max("entity").alias("other"))
    # A stem or surname that is nobody's as it stands is looked for by its one-edit forms.
    near = keys.select("kind", "extra", "main", "entity", "other", F.explode(edit_forms("kind", "main")).alias("form")).withColumn("spelt", is_self)
    near = near.groupBy("kind", "extra", "form", "spelt").agg(F.min("entity").alias("near"), F.max("other").alias("near_other"))
    asked = part.join(merged(keys), ["kind", "main", "extra"], "left").withColumn("own", F.concat_ws("|", "kind", "main", "extra"))
    found = asked.where("entity is not null").where("entity = other").select("name", "entity")
    loose = asked.where("entity is null").select("name", "kind", "main", "extra", "own", F.explode(edit_forms("kind", "main")).alias("form")).withColumn("whole", is_self)
    loose = loose.join(merged(near), ["kind", "extra", "form"], "left").withColumns({c: F.when(~F.col("form").startswith("~") | F.col("spelt") | F.col("whole"), F.col(c)) for c in ("near", "near_other")}).groupBy("name", "own").agg(F.min("near").alias("near"), F.max("near_other").alias("near_other"))
    loose = loose.where("near is null or near = near_other").select("name", F.coalesce("near", "own").alias("entity"))
    incomplete = found.unionByName(loose)
    return complete.unionByName(incomplete)


FIELDS = (("archive_documents", "party_a"), ("archive_documents", "party_b"), ("document_seals", "owner"))


def spellings(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling of the three fields with its count; pre-aggregated before the one shuffle, so a hot owner is one row."""
    parts = [table(spark, folder, t).select(F.col(c).alias("name")).where("name is not null") for t, c in FIELDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("name").agg(F.count("*").alias("n"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different spellings of one entity, the smaller by code points first."""
    linked = materialise(link_names(spellings(spark, folder)), "linked")
    a, b = linked.select(F.col("name").alias("name_lo"), "entity"), linked.select(F.col("name").alias("name_hi"), "entity")
    return a.join(merged(b), "entity").where("name_lo < name_hi").select("name_lo", "name_hi").distinct()


def p3_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Each spelling with its entity and the number of spellings linked to it."""
    linked = materialise(link_names(spellings(spark, folder)), "linked")
    size = linked.groupBy("entity").agg(F.count("*").alias("n"))
    return linked.join(merged(size), "entity").select("name", "entity", (F.col("n") - 1).alias("links"))
