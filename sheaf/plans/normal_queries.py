"""Queries of the normalisers over the archive's dirty columns, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import normalise as N
from sheaf.plans.registry import query
from sheaf.sources.tables import table

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
WSFREE = r"regexp_replace({0}, '[\s　 \x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}]+', '', 'g')"
DATE = r"^((?:19|20)[0-9][0-9])\s*[年\-./]\s*([0-9]{1,2})\s*[月\-./]\s*([0-9]{1,2})"


@query(
    "norm_date",
    rf"""select distinct id, case when date_text = '' then null when regexp_matches(date_text, '{DATE}') then regexp_extract(date_text, '{DATE}', 1) || '-' || lpad(regexp_extract(date_text, '{DATE}', 2), 2, '0')
    || '-' || lpad(regexp_extract(date_text, '{DATE}', 3), 2, '0') else date_text end as iso from labeled_dates""",
)
def norm_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labeled_dates").select("id", N.norm_date("date_text").alias("iso")).distinct()


@query(
    "norm_money_arabic",
    r"""with a as (select distinct id, amount_text as t from archive_documents where amount_text is not null), b as (select id, t, regexp_extract(t, '([0-9]+(?:[,，][0-9]{3})*(?:\.[0-9]+)?)\s*(万元|万|千元|百元|元|圆)?', 1) as n,
    regexp_extract(t, '([0-9]+(?:[,，][0-9]{3})*(?:\.[0-9]+)?)\s*(万元|万|千元|百元|元|圆)?', 2) as u from a)
    select id, round(try_cast(replace(replace(n, ',', ''), '，', '') as double) * case when u in ('万', '万元') then 10000 when u = '千元' then 1000 when u = '百元' then 100 else 1 end, 4) as yuan from b""",
)
def norm_money_arabic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "archive_documents").where("amount_text is not null").select("id", F.round(N.money_arabic("amount_text"), 4).alias("yuan")).distinct()


def _nested(c: str, words: list[str], by: str) -> str:
    for w in words:
        c = f"replace({c}, '{w}', '{by}')"
    return c


_S = "regexp_replace(replace(replace(replace(amount_text, '人民币', ''), '圆', '元'), '整', ''), '^\\s+|\\s+$', '', 'g')"


@query(
    "norm_money_chinese",
    f"""with a as (select distinct id, translate({_S}, '零壹贰叁肆伍陆柒捌玖一二三四五六七八九两拾佰仟', '01234567891234567892十百千') as s from archive_documents where amount_text is not null and not regexp_matches(amount_text, '[0-9]')),
    b as (select id, split_part(s, '元', 1) as w, case when contains(s, '元') then split_part(s, '元', 2) else '' end as tail from a),
    c as (select id, w, coalesce(list_sum(list_transform(regexp_extract_all(replace(w, ' ', ''), '[^万亿]*[万亿]|[^万亿]+$'), lambda x: (case when x like '%万' then 10000 when x like '%亿' then 100000000 else 1 end) * (
        coalesce(list_sum(list_transform(regexp_extract_all(x, '([0-9]?)十', 1), lambda y: 10 * greatest(coalesce(try_cast(y as bigint), 0), 1))), 0)
        + coalesce(list_sum(list_transform(regexp_extract_all(x, '([0-9]?)百', 1), lambda y: 100 * greatest(coalesce(try_cast(y as bigint), 0), 1))), 0)
        + coalesce(list_sum(list_transform(regexp_extract_all(x, '([0-9]?)千', 1), lambda y: 1000 * greatest(coalesce(try_cast(y as bigint), 0), 1))), 0)
        + coalesce(try_cast(regexp_extract(x, '([0-9])[万亿]?$', 1) as bigint), 0)))), 0) as yuan,
      coalesce(try_cast(regexp_extract(tail, '([0-9])角', 1) as int), 0) * 0.1 + coalesce(try_cast(regexp_extract(tail, '([0-9])分', 1) as int), 0) * 0.01 as part from b)
    select id, case when regexp_full_match(w, '[0-9十百千万亿 ]*') and (regexp_matches(w, '[0-9十百千万亿]') or part > 0) and yuan + part > 0 then round(yuan + part, 2)::double end as yuan from c""",
)
def norm_money_chinese(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "archive_documents").where("amount_text is not null and not amount_text rlike '[0-9]'").select("id", N.money_chinese("amount_text").alias("yuan")).distinct()


@query("cents", "select distinct id, cast(round_even(value * 100, 0) as bigint) as cents from labeled_amounts")
def cents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labeled_amounts").select("id", N.cents("value").alias("cents")).distinct()


@query(
    "coerce_bool",
    "select distinct id, case lower(trim(cast(auto_renewal as varchar))) when '1' then true when '0' then false end as renewal, case lower(status) when 'yes' then true when 'no' then false end as other from archive_documents",
)
def coerce_bool(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "archive_documents").select("id", N.coerce_bool("auto_renewal").alias("renewal"), N.coerce_bool("status").alias("other")).distinct()


NAMES = "names as (select distinct n from (select party_a as n from archive_documents union all select party_b from archive_documents union all select owner from document_seals) where n is not null)"


def names(spark: SparkSession, d: str) -> DataFrame:
    a, s = table(spark, d, "archive_documents"), table(spark, d, "document_seals")
    return a.select(F.col("party_a").alias("n")).unionByName(a.select(F.col("party_b").alias("n"))).unionByName(s.select(F.col("owner").alias("n"))).where("n is not null").distinct()


@query("canon_value", rf"with {NAMES} select n as name, regexp_replace(n, '[\s　 ;；,，、:：.。\-—_／/]', '', 'g') as canon from names")
def canon_value(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).select(F.col("n").alias("name"), N.canon_value("n").alias("canon"))


@query("canon_name", rf"with {NAMES} select n as name, regexp_replace(trim(n, ' 　'), '^(?:{'|'.join(N.ROLE_PREFIXES)})(?:[\s　]*[:：、|/\\\-]+[\s　]*|[\s　]+)', '') as canon from names")
def canon_name(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).select(F.col("n").alias("name"), N.canon_name("n").alias("canon"))


_V = "lower(replace(replace(trim(text), ' ', ''), '　', ''))"
_J = "replace(" + _V + ", '', '')"
for _w in N.CURRENCY_JUNK:
    _J = f"replace({_J}, '{_w}', '')"
_J = f"replace({_J}, '万元', '万')"


@query(
    "fusion_norm",
    f"""with t as (select distinct id, {_V} as s, {_J} as b from labeled_amounts where text is not null) select id, case when regexp_matches(s, '[0-9]') then
    case when regexp_full_match(b, '[0-9]+个?月') and cast(regexp_extract(b, '[0-9]+') as bigint) % 12 = 0 then (cast(regexp_extract(b, '[0-9]+') as bigint) // 12) || '年' else b end else s end as norm from t""",
)
def fusion_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labeled_amounts").where("text is not null").select("id", N.fusion_value("text").alias("norm")).distinct()


def _any(c: str, words: list[str]) -> str:
    return f"regexp_matches({c}, '{'|'.join(words)}')"


@query(
    "role_group",
    f"with {NAMES} select n as name, case when {_any('n', N.GROUP_A)} then 'A' when {_any('n', N.GROUP_B)} then 'B' else '' end as side, {_any('n', N.STRONG_LABELS)} as strong from names",
)
def role_group(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).select(F.col("n").alias("name"), N.role_group("n").alias("side"), N.is_strong_label("n").alias("strong"))


_I = "replace(replace(" + _nested(_nested("lower(replace(replace(item, ' ', ''), '　', ''))", N.SIDE_A_TERMS, "甲方"), N.SIDE_B_TERMS, "乙方") + ", '乙方乙方', '乙方'), '甲方甲方', '甲方')"


@query(
    "issue_items",
    rf"""with t as (select distinct id, {_I} as item, regexp_extract(evidence, '第\s*([0-9]+)\s*页', 1) as p from completeness_issues) select id, item,
    case when contains(item, '双方') or (contains(item, '甲方') and contains(item, '乙方')) then '双' when contains(item, '甲方') then '甲' when contains(item, '乙方') then '乙' else '' end as side, try_cast(p as integer) as page from t""",
)
def issue_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "completeness_issues").select("id", N.issue_item("item").alias("item"), N.issue_side(N.issue_item("item")).alias("side"), N.evidence_page("evidence").alias("page")).distinct()


@query(
    "seal_numbers",
    r"with t as (select distinct id, list_transform(regexp_extract_all(coalesce(raw_text, ''), '[0-9]{6,}'), lambda x: x) as r from document_seals) select id, coalesce(list_extract(list_sort(list_transform(r, lambda x, i: {'k': -length(x), 'i': i, 'x': x})), 1).x, '') as seal_no from t",
)
def seal_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_seals").select("id", N.seal_number(F.lit(""), "raw_text").alias("seal_no")).distinct()


@query(
    "truncate_middle",
    "select doc_id, case when length(text) > 300 then substr(text, 1, 100) || '…' || right(text, 200) else text end as short_text from documents",
)
def truncate_middle(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", N.truncate_middle("text", 300, "…").alias("short_text"))


@query(
    "classify_error",
    """select distinct ts, sha, case when error = 'RATE_LIMITED' then 'RATE_LIMITED' when contains(lower(coalesce(error, '')), 'timeout') then 'TIMEOUT' when error = 'UPSTREAM_ERROR' then 'UPSTREAM_ERROR' else 'UNKNOWN' end as code,
    coalesce(error in ('RATE_LIMITED', 'UPSTREAM_ERROR', 'TIMEOUT'), false) as retry from ingest_log""",
)
def classify_error(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("error") == "RATE_LIMITED", "RateLimitError").when(F.col("error") == "UPSTREAM_ERROR", "InternalServerError")
    code = N.error_code(name, F.lit(None).cast("int"), "error")
    return table(spark, d, "ingest_log").select("ts", "sha", code.alias("code"), N.retryable(code).alias("retry")).distinct()
