"""Text in one form of characters: look-alike mapping, grouped under an accent-sensitive Unicode collation.

Each value is mapped character by character (invisible characters out, unusual spaces plain, full-width letters and
signs narrow, compatibility Han unified, accents composed, look-alike letters of other scripts to Latin where the word
is not of that script's own language).  Values whose mapped forms are equal under the collation UNICODE, which tells
accents apart, form a class; the smallest mapped form is its canonical member and is joined back to all rows.

Edge cases: null texts give no row, empty texts are their own form; texts of any length are mapped whole; words wholly
of another script's own language, traditional characters and usual Chinese punctuation stay; repeated rows give one row.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.vectorised import vectorised
from sheaf.sources.tables import materialise, table

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУҮХаеѕіјорсухһԁԛԝӏѵ", "ABESIJKMHOPCTYYXaesijopcyxhdqwlv"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj"))
OTHER = {**CYRILLIC, **GREEK}
#: Armenian, Cherokee, small capitals, phonetic letters and numerals: Latin where the word has a Latin letter.
EXOTIC = dict(zip("օսոաԱՕᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏤᎳᏃᴀʙᴄᴅᴇɢʜɪᴊᴋʟᴍɴᴏᴘʀᴛᴜᴠᴡʏᴢɑɡⅼⅽⅾⅿⅰⅴⅹⅠⅤⅩⅬⅭⅮⅯ", "ounwUOABCDEHJKLMPRSTVWZABCDEGHIJKLMNOPRTUVWYZaglcdmivxIVXLCDM"))
LATIN = {v: k for k, v in reversed(CYRILLIC.items())}
KEPT_WIDE = "（），：；！？"
SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"
INVISIBLE = "[\xad͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff]"
COMPATIBLE = "[⺀-⿟豈-﫿\U0002f800-\U0002fa1fﬀ-ﬆ\U0001d400-\U0001d7ffKÅΩ]"
#: Any text with none of these is in its form already; the test runs in the JVM.
SUSPECT = "[̀-ԯ" + "".join(EXOTIC) + SPACES + "！-＇＊＋－-９＜-＞＠-～]|" + INVISIBLE + "|" + COMPATIBLE
WORD = re.compile("[A-Za-zÀ-ɏ̀-ԯ0-9]+")
_SINGLE = {ord(c): " " for c in SPACES} | {0xFF01 + i: chr(0x21 + i) for i in range(94) if chr(0xFF01 + i) not in KEPT_WIDE}
_INVISIBLE = re.compile(INVISIBLE)
_MARKED = re.compile("[^\u0300-\u036f][\u0300-\u036f]+")
_COMPATIBLE = re.compile(COMPATIBLE)
_EXOTIC = re.compile("[" + "".join(EXOTIC) + "]")
_MIXED = re.compile("[A-Za-zÀ-ɏ̀-ԯ0-9" + "".join(EXOTIC) + "]+")
_FOREIGN = re.compile("[Ͱ-ԯ]")


def composed(text: str) -> str:
    """Detached accents put onto their letters; other scripts' own sequences stay."""
    return _MARKED.sub(lambda m: unicodedata.normalize("NFC", m.group()), text)


def one_form(text: str) -> str:
    """The text with every character in its ordinary form."""
    text = _COMPATIBLE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), _INVISIBLE.sub("", text).translate(_SINGLE))
    text = composed(text)
    if _EXOTIC.search(text):
        text = _MIXED.sub(lambda m: "".join(EXOTIC.get(c, c) for c in m.group()) if re.search("[A-Za-z]", m.group()) else m.group(), text)
    if not _FOREIGN.search(text):
        return text
    words = WORD.findall(text)
    # Scripts written here in their own language: a word wholly of the script with a letter no Latin letter looks like.
    own = {s for w in words if not re.search("[A-Za-z]", w) for s in (_script(w),) if s and any(_FOREIGN.match(c) and c not in OTHER for c in w)}

    def fix(m: re.Match) -> str:
        word = m.group()
        letters = [c for c in word if _FOREIGN.match(c)]
        if not letters:
            return word
        alien = [c for c in letters if c not in OTHER]
        latin = re.search("[A-Za-zÀ-ɏ]", word)
        if alien:
            if latin and _script(word) == "c" and len(alien) + 1 >= len(re.findall("[A-Za-z]", word)):
                return "".join(LATIN.get(c, c) for c in word)  # a Latin letter within another language's word
            return word if not latin else "".join(OTHER.get(c, c) for c in word)
        if not latin and _script(word) in own:
            return word
        return "".join(OTHER.get(c, c) for c in word)

    return composed(WORD.sub(fix, text))


def _script(word: str) -> str:
    """'c' or 'g' where the word's foreign letters are all Cyrillic or all Greek, else ''."""
    found = {"g" if c < "Ѐ" else "c" for c in word if _FOREIGN.match(c)}
    return found.pop() if len(found) == 1 else ""


@vectorised("string")
def mapped(texts: pd.Series) -> pd.Series:
    memo = {t: one_form(t) for t in set(texts)}
    return texts.map(memo)


def canonical_texts(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` (with non-null ``text``) with ``mapped`` and ``canonical``, its class's member.

    Only texts with a suspect character are mapped in Python.  The classes are aggregated on both sides of the shuffle
    before the join, so that a form held by a third of all rows is one class row; the join itself is left to AQE."""
    spark = rows.sparkSession
    plain = rows.where(~F.col(text).rlike(SUSPECT)).withColumn("mapped", F.col(text))
    odd = materialise(rows.where(F.col(text).rlike(SUSPECT)).withColumn("mapped", mapped(text)), "mapped")  # mapped once, read twice
    both = odd.unionByName(plain)
    classes = spark.sql(
        "SELECT collate(mapped, 'UNICODE') AS class, min(mapped) AS canonical FROM {forms} GROUP BY collate(mapped, 'UNICODE')",
        forms=both.select("mapped").distinct(),
    )
    return spark.sql("SELECT r.*, c.canonical FROM {rows} r JOIN {classes} c ON collate(r.mapped, 'UNICODE') = c.class", rows=both, classes=classes)


FIELDS = (("document_seals", "raw_text"), ("completeness_issues", "evidence"), ("archive_documents", "title"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, t).select(F.lit(f"{t}.{c}").alias("field_name"), F.col("id").alias("row_id"), F.col(c).alias("text")).where("text is not null") for t, c in FIELDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose text is not in its canonical form; rows without a suspect character can be none and are left out first."""
    suspects = texts(spark, folder).where(F.col("text").rlike(SUSPECT))
    return canonical_texts(suspects).where("text <> canonical").select("field_name", "row_id").distinct()


def p4_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every row's text in its canonical form."""
    return canonical_texts(texts(spark, folder)).select("field_name", "row_id", "canonical").distinct()
