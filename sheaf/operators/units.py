"""Quantities in many units and scales to one common unit per kind.

Every row is split into its number and the spelling of its unit (``#`` stands where the number stood).  The distinct
spellings, few against the rows, are mapped to reference spellings, which are made by rule from money words, scales,
areas, counts and periods: a character n-gram inverted index proposes candidates and a weighted edit distance, in
which separators and filler words weigh little, verifies them: any spelling may differ in these, one of some length also in
one character or two swapped neighbours.  A misspelling that fits several units stays unmapped.  The resulting alias
dictionary, with an exact factor for each spelling, is joined to all rows, and values are exact fractions rounded half up
once.  A text of several clauses with a number each holds several quantities.

Edge cases: null and blank texts, texts without a number, spellings near no reference (``p5_unmapped`` reports these) and
values beyond a bigint give no row; repeated rows give one row; rates are not compounded.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.vectorised import vectorised
from sheaf.sources.tables import materialise, table

# Words and signs of the currencies, scales, areas, counts and periods.
CURRENCIES = {"USD": "us$ usd 美元 $ 美金 dollars", "HKD": "hk$ hkd 港币 港元", "EUR": "€ eur 欧元 euro euros", "JPY": "jp¥ jpy 日元 円 yen", "GBP": "£ gbp 英镑 pounds"}
YUAN = ("元", "圆", "块", "块钱", "rmb", "cny", "¥", "人民币", "人民币元", "yuan")
SCALES = {
    "": 1, "百": 100, "佰": 100, "千": 1000, "仟": 1000, "k": 1000, "thousand": 1000, "万": 10**4, "w": 10**4, "十万": 10**5, "百万": 10**6, "m": 10**6, "mn": 10**6, "million": 10**6,
    "千万": 10**7, "亿": 10**8, "bn": 10**9, "billion": 10**9,
}
PARTS = {"角": Fraction(1, 10), "分": Fraction(1, 100), "毛": Fraction(1, 10)}
MU, SQUARE_FOOT = Fraction(2000, 3), Fraction("0.09290304")
AREAS = {
    "平米": (1, True), "平方米": (1, True), "m2": (1, True), "平方公尺": (1, True), "平方": (1, True), "sqm": (1, True), "亩": (MU, False), "公顷": (10**4, False), "平方英尺": (SQUARE_FOOT, False),
    "sqft": (SQUARE_FOOT, False), "ft2": (SQUARE_FOOT, False), "平方公里": (10**6, False), "坪": (Fraction(400, 121), False), "百平米": (100, False), "百平方米": (100, False),
}
COUNTS = {"个": 1, "只": 1, "位": 1, "十个": 10, "百个": 100, "千个": 1000}
# How many months a period has.
PERIODS = {
    "月": 1, "month": 1, "mo": 1, "年": 12, "year": 12, "yr": 12, "季": 3, "季度": 3, "quarter": 3, "半年": 6, "半月": Fraction(1, 2), "双月": 2, "日": Fraction(12, 365), "天": Fraction(12, 365), "day": Fraction(12, 365), "周": Fraction(84, 365), "week": Fraction(84, 365), "旬": Fraction(1, 3),
}
RATES = {"%": 1, "‰": Fraction(1, 10), "bp": Fraction(1, 100), "bps": Fraction(1, 100), "万分之": Fraction(1, 100), "千分之": Fraction(1, 10), "百分之": 1, "分利": 1, "厘利": Fraction(1, 10)}
FILLERS = "每期约定共整正含税不约合计另计为即按"
# Units of other kinds: a spelling with one of these is no misspelling of ours.
OTHER_UNITS = "公斤 千克 克 吨 斤 升 米/ 公里/ 小时 分钟 秒 次 人 户 台 辆 套 件 间 张 份 页 kg ton tonne litre hour km/".split()
SEPARATORS = "/·.,;:() -*"
NUMBER = re.compile(r"\d[\d,]*(?:\.\d+)?")
CN_DIGITS = {c: i % 10 for i, c in enumerate("零一二三四五六七八九〇壹贰叁肆伍陆柒捌玖")} | {"两": 2, "贰": 2}
CN_TENS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
CN_NUMBER = re.compile("[零〇一二三四五六七八九十百千万亿两壹贰叁肆伍陆柒捌玖拾佰仟]+")
CLAUSE = re.compile(r"[，；。;\n]|(?<!\d),|,(?!\d{3})")
CN_SUM = re.compile(r"(#?)([零〇一二三四五六七八九十百千万亿两壹贰叁肆伍陆柒捌玖拾佰仟]+)(元|圆|块钱|块)整?(?:([一二三四五六七八九壹贰叁肆伍陆柒捌玖零〇])[角毛])?零?(?:([一二三四五六七八九壹贰叁肆伍陆柒捌玖])分)?")


def cn_number(text: str) -> int:
    """Chinese numerals, capital or plain, up to 亿."""
    total = section = digit = 0
    for c in text:
        if c in CN_DIGITS:
            digit = CN_DIGITS[c]
        elif c in CN_TENS:
            section, digit = section + (digit or (1 if not section else 0)) * CN_TENS[c], 0
        elif c == "万":
            total, section, digit = total + (section + digit) * 10**4, 0, 0
        else:
            total, section, digit = (total + section + digit) * 10**8, 0, 0
    return total + section + digit


def flat(text: str) -> str:
    """Half width, lower case, no blanks; square metres as one word."""
    text = unicodedata.normalize("NFKC", text.replace("㎡", "平米").replace("平方米", "平方米")).lower()
    return re.sub(r"\s+", "", text).replace("sq.ft", "sqft").replace("p.a.", "/year").replace("p.a", "/year").replace("per", "/")


def split_quantity(text: str | None, unit: str | None) -> tuple[str, str, bool] | None:
    """(number as a fraction's text, spelling with # for the number, whether in Chinese numerals), or None.

    A text that gives the sum both in Chinese numerals and in figures counts by its figures."""
    body = flat(text or "")
    if not body:
        return None
    m = NUMBER.search(body)
    if not m:
        c = CN_SUM.search(body)
        if c:
            value = Fraction(cn_number(c.group(2))) + Fraction(CN_DIGITS[c.group(4)] if c.group(4) else 0, 10) + Fraction(CN_DIGITS[c.group(5)] if c.group(5) else 0, 100)
            return str(value), body[: c.start()] + "#元" + body[c.end() :], True
        n = CN_NUMBER.search(body)
        if not n:
            return None
        spelling = body[: n.start()] + "#" + body[n.end() :]
        return str(Fraction(cn_number(n.group(0)))), spelling if spelling != "#" or not unit else "#" + flat(unit), True
    value = Fraction(m.group(0).replace(",", "").rstrip("."))
    before, after = body[: m.start()], body[m.end() :]
    spelled = CN_SUM.search(before)
    if spelled:
        before = before[spelled.end() :]
    spelling = before + "#" + after
    if unit and not re.search(r"[^\s#()" + FILLERS + "]", spelling):
        spelling = spelling.rstrip("#") + "#" + flat(unit) if spelling.endswith("#") else spelling + flat(unit)
    return str(value), spelling, False


def split_quantities(text: str | None, unit: str | None) -> list[tuple[str, str, bool]]:
    """All quantities of a text: each of several clauses with a number is one, else the whole text is."""
    clauses = [c for c in CLAUSE.split(text or "") if NUMBER.search(c) or CN_SUM.search(flat(c))]
    found = [split_quantity(c, unit) for c in (clauses if len(clauses) > 1 else [text])]
    return [f for f in found if f]


def references(fx: dict[str, str]) -> dict[str, tuple[str, Fraction, bool]]:
    """Reference spellings by rule: spelling -> (common unit, factor to it, whether it is that unit's plain form)."""
    out: dict[str, tuple[str, Fraction, bool]] = {}

    def put(spelling: str, unit: str, factor: Fraction, plain: bool) -> None:
        out.setdefault(spelling, (unit, Fraction(factor), plain))

    for w in YUAN:
        for s, k in SCALES.items():
            put(f"#{s}{w}", "元", k, k == 1)
            put(f"{w}#{s}", "元", k, k == 1)
            for tail in ("元", "rmb", "人民币"):
                put(f"{w}#{s}{tail}", "元", k, k == 1)
                put(f"#{s}{w}({tail})", "元", k, k == 1)
    for w, k in PARTS.items():
        put(f"#{w}", "元", k, False)
        for lead in ("人民币", "rmb", "cny"):
            put(f"{lead}#{w}", "元", k, False)
            put(f"#{w}({lead})", "元", k, False)
    for s, k in SCALES.items():
        if k >= 10**4:
            put(f"#{s}", "元", k, False)
    for code, words in CURRENCIES.items():
        if code not in fx:
            continue
        rate = Fraction(fx[code])
        for w in words.split():
            for s, k in SCALES.items():
                put(f"#{s}{w}", "元", rate * k, False)
                put(f"{w}#{s}", "元", rate * k, False)
                put(f"{w}#{s}元", "元", rate * k, False)
    spread = {s + w: (Fraction(k), k == 1) for w in ("元", "rmb", "cny", "人民币", "¥") for s, k in SCALES.items() if s in ("", "百", "千", "万", "k")}
    spread |= {w: (k, False) for w, k in PARTS.items()}
    spread |= {s + w: (Fraction(fx[c]) * SCALES[s], False) for c, words in CURRENCIES.items() if c in fx for w in words.split() for s in ("", "万")}
    for w, (k, plain) in spread.items():
        for a, (size, square) in AREAS.items():
            put(f"#{w}/{a}", "元/㎡", k / size, plain and square)
            for p, months in PERIODS.items():
                for form in (f"#{w}/{a}/{p}", f"#{w}/{p}/{a}"):
                    put(form, "元/月·㎡", k / size / months, plain and square and months == 1)
        for p, months in PERIODS.items():
            put(f"#{w}/{p}", "元/月", k / months, plain and months == 1)
            put(f"每{p}#{w}", "元/月", k / months, plain and months == 1)
            for c, n in COUNTS.items():
                for form in (f"#{w}/{c}/{p}", f"#{w}/{p}/{c}"):
                    put(form, "元/个/月", k / n / months, plain and n == 1 and months == 1)
    for w, k in RATES.items():
        for p, months in PERIODS.items():
            plain, factor = w in ("%", "百分之") and months == 12, Fraction(k) * 12 / months
            for form in (f"#{w}/{p}", f"#{p}{w}", f"{p}#{w}", f"{p}{w}#", f"每{p}{w}#", f"每{p}#{w}", f"{w}#/{p}"):
                put(form, "%/年", factor, plain)
    for p, months in PERIODS.items():
        for w, k in (("分", 1), ("厘", Fraction(1, 10))):
            put(f"{p}息#{w}", "%/年", Fraction(k) * 12 / months, False)
            put(f"{p}利#{w}", "%/年", Fraction(k) * 12 / months, False)
        for w, k in (("%", 1), ("‰", Fraction(1, 10))):
            put(f"{p}息#{w}", "%/年", Fraction(k) * 12 / months, months == 12 and w == "%")
            put(f"{p}利率#{w}", "%/年", Fraction(k) * 12 / months, months == 12 and w == "%")
    return out


def weight(c: str) -> float:
    return 0.05 if c in SEPARATORS else 0.1 if c in FILLERS else 1.0


def weighted_distance(a: str, b: str, most: float) -> float:
    """Edit distance in which leaving out or adding a character costs its weight, a change the larger weight and a swap of
    neighbours as much as a change."""
    before: list[float] = []
    row = [0.0]
    for y in b:
        row.append(row[-1] + weight(y))
    for i, x in enumerate(a):
        new = [row[0] + weight(x)]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + weight(x), new[-1] + weight(y), row[j - 1] + (0.0 if x == y else max(weight(x), weight(y))))
            if i and j > 1 and x == b[j - 2] and a[i - 1] == y:
                cost = min(cost, before[j - 2] + max(weight(x), weight(y)))
            new.append(cost)
        before, row = row, new
        if min(row) > most and min(before) > most:
            return most + 1
    return row[-1]


class SpellingIndex:
    """Inverted index from character n-grams to reference spellings.

    N-grams of more than ``common`` references are not posted: they tell little, and candidates must share all but
    so many of the others."""

    def __init__(self, spellings: list[str], n: int = 2, common: int = 20_000):
        self.n, self.spellings = n, spellings
        self.grams: dict[str, list[int]] = defaultdict(list)
        for i, s in enumerate(spellings):
            for g in self.of(s):
                self.grams[g].append(i)
        self.common = {g for g, of in self.grams.items() if len(of) > common}
        for g in self.common:
            del self.grams[g]

    def core(self, text: str) -> str:
        return "".join(c for c in text if weight(c) == 1.0)

    def of(self, text: str) -> set[str]:
        core = f"^{self.core(text)}$"
        return {core[i : i + self.n] for i in range(len(core) - self.n + 1)}

    def allowed(self, text: str) -> int:
        """Full characters that may differ: one in four or more beside the number."""
        if any(u in text for u in OTHER_UNITS):
            return 0
        core = self.core(text).replace("#", "")
        return int(len(core) >= 4)

    def nearest(self, text: str, most: float = 0.75, meaning=lambda s: s) -> tuple[float, str] | None:
        """The nearest reference, ties to the shorter; ``most`` is what separators and fillers may cost.

        Where a full character differs, all references as near as the nearest must have one ``meaning``."""
        mine = self.of(text) - self.common
        shared: dict[int, int] = defaultdict(int)
        for g in mine:
            for i in self.grams.get(g, ()):
                shared[i] += 1
        for edits in range(self.allowed(text) + 1):
            # An edit or swap touches n + 1 n-grams at most; below one edit all are left in place.
            least, limit = len(mine) - edits * (self.n + 1), most + edits
            if least < 1:
                return None
            found = sorted((weighted_distance(text, s, limit), len(s), s) for i, k in shared.items() if k >= least for s in (self.spellings[i],))
            found = [f for f in found if f[0] <= limit]
            if found:
                alike = {meaning(s) for d, _, s in found if d < found[0][0] + 0.05}
                return (found[0][0], found[0][2]) if not edits or len(alike) == 1 else None
        return None


def quantity(text: str, unit: str) -> Column:
    """The quantities of each text as an array; evaluated once, not again in each use of a field."""

    def run(texts: pd.Series, units: pd.Series) -> pd.Series:
        return pd.Series([split_quantities(t, u) for t, u in zip(texts, units)])

    return F.pandas_udf(run, "array<struct<number:string,spelling:string,numerals:boolean>>").asNondeterministic()(text, unit)


def alias_dictionary(spellings: DataFrame, fx: DataFrame) -> DataFrame:
    """Each distinct spelling with its common unit, factor (two integers as text) and whether it is the plain form."""
    known = fx.where(F.col("currency").isin(list(CURRENCIES)) & F.col("yuan_per_unit").isNotNull()).groupBy("currency").agg(F.max("yuan_per_unit").alias("rate"))
    rates = {r.currency: r.rate for r in known.collect()}  # one row a currency of the list
    built: dict = {}

    def run(batches):
        if not built:
            built["refs"] = references(rates)
            built["index"] = SpellingIndex(list(built["refs"]))
        refs = built["refs"]
        for pdf in batches:
            rows = []
            for s in pdf["spelling"]:
                hit = (0.0, s) if s in refs else built["index"].nearest(s, meaning=lambda r: refs[r][:2])
                if hit:
                    unit, factor, plain = refs[hit[1]]
                    rows.append((s, hit[1], hit[0], unit, str(factor), plain))
            yield pd.DataFrame(rows, columns=["spelling", "reference", "distance", "common_unit", "factor", "plain"])

    return spellings.mapInPandas(run, "spelling string, reference string, distance double, common_unit string, factor string, plain boolean")


@vectorised("decimal(38,0)")
def exact_e4(numbers: pd.Series, factors: pd.Series) -> pd.Series:
    """number x factor x 10,000, rounded half up from the exact fraction."""
    from decimal import Decimal

    out = []
    for n, f in zip(numbers, factors):
        x = Fraction(n) * Fraction(f) * 20000 + 1
        out.append(Decimal(x.numerator // x.denominator // 2) if x >= 0 else Decimal(-((-x.numerator) // x.denominator // 2)))
    return pd.Series(out, dtype=object)


def convert(rows: DataFrame, fx: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """``rows`` (text, unit and any others) with number, spelling, numerals, common_unit, factor, plain and common_e4.

    The dictionary has one row for each distinct spelling; it is broadcast only up to ``broadcast_rows`` of them."""
    parsed = rows.withColumn("_q", F.explode(quantity("text", "unit"))).select(*[c for c in rows.columns if c not in ("number", "spelling", "numerals")], "_q.*")
    aliases = materialise(alias_dictionary(parsed.select("spelling").distinct(), fx), "aliases")
    small = aliases.count() <= broadcast_rows
    joined = parsed.join(F.broadcast(aliases) if small else aliases, "spelling")
    return joined.withColumn("common_e4", exact_e4("number", "factor").try_cast("bigint")).where("common_e4 is not null")


def quantities(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "labeled_amounts").select(F.lit("labeled_amounts").alias("table_name"), F.col("id").alias("row_id"), "text", "unit")
    b = table(spark, folder, "archive_documents").select(F.lit("archive_documents").alias("table_name"), F.col("id").alias("row_id"), F.col("amount_text").alias("text"), F.lit(None).cast("string").alias("unit"))
    return a.unionByName(b).where("text is not null")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows recorded otherwise than in figures of the common unit, with the value in it times 10,000."""
    done = convert(quantities(spark, folder), table(spark, folder, "fx_rates"))
    return done.where("numerals or not plain").select("table_name", "row_id", "common_unit", "common_e4").distinct()


def p5_converted(spark: SparkSession, folder: str) -> DataFrame:
    """All rows in their common unit."""
    done = convert(quantities(spark, folder), table(spark, folder, "fx_rates"))
    return done.select("table_name", "row_id", "common_unit", "common_e4").distinct()


def p5_unmapped(spark: SparkSession, folder: str) -> DataFrame:
    """Spellings near no reference, with how many rows have them."""
    rows = quantities(spark, folder).select(F.explode(quantity("text", "unit")).alias("_q")).select("_q.*")
    counts = rows.groupBy("spelling").agg(F.count("*").alias("n"))
    known = alias_dictionary(counts.select("spelling"), table(spark, folder, "fx_rates"))
    return counts.join(known, "spelling", "left_anti").select("spelling", "n")
