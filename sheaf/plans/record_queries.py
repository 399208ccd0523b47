"""Queries of record coercion and checks over the envelopes and labelled amounts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import normalise as N
from sheaf.operators import records as R
from sheaf.plans.registry import query
from sheaf.sources.tables import table

ENV = "env as (select distinct id as doc_id, sha256, ingested_at, details_json::json as j from archive_documents where json_valid(details_json) and details_json is not null)"
T = "trim(coalesce({0}, ''), e' \\t\\n　')"


def envelopes(spark: SparkSession, d: str, *more: str) -> DataFrame:
    docs = table(spark, d, "archive_documents").select(F.col("id").alias("doc_id"), *more, "details_json").distinct()
    return docs.select("doc_id", *more, R.answer("details_json").alias("v")).where("v is not null")


def items(path: str, name: str = "x") -> str:
    """SQL of the objects of a list with their places."""
    return f"(select doc_id, sha256, ingested_at, unnest(range(json_array_length(j, '{path}')::bigint)) as pos, j from env where json_type(j, '{path}') = 'ARRAY')"


def js(x: str, key: str) -> str:
    return T.format(f"json_extract_string({x}, '$.{key}')")


@query("envelope_doc_type", f"with {ENV} select doc_id, case when {js('j', 'doc_type')} in ({', '.join(repr(t) for t in R.DOC_TYPES)}) then {js('j', 'doc_type')} else '其他' end as doc_type from env")
def envelope_doc_type(spark: SparkSession, d: str) -> DataFrame:
    return envelopes(spark, d).select("doc_id", R.doc_type(F.col("v")).alias("doc_type")).distinct()


@query(
    "envelope_dates",
    rf"""with {ENV}, a as (select doc_id, pos::int as pos, json_extract(j, '$.key_dates[' || pos || ']') as x from {items('$.key_dates')}), b as (select doc_id, pos, {js('x', 'label')} as l, nullif({js('x', 'date')}, '') as dt from a where json_type(x) = 'OBJECT')
    select doc_id, pos, case when l = '' then '日期' else l end as label, case when regexp_matches(dt, '^((?:19|20)[0-9][0-9])\s*[年\-./]\s*([0-9]{{1,2}})\s*[月\-./]\s*([0-9]{{1,2}})') then regexp_extract(dt, '^([0-9]{{4}})', 1) || '-' ||
    lpad(regexp_extract(dt, '^[0-9]{{4}}\s*[年\-./]\s*([0-9]{{1,2}})', 1), 2, '0') || '-' || lpad(regexp_extract(dt, '^[0-9]{{4}}\s*[年\-./]\s*[0-9]{{1,2}}\s*[月\-./]\s*([0-9]{{1,2}})', 1), 2, '0') else dt end as date from b where l <> '' or dt is not null""",
)
def envelope_dates(spark: SparkSession, d: str) -> DataFrame:
    return R.envelope_dates(envelopes(spark, d), "v", "doc_id")


@query(
    "envelope_amounts",
    f"""with {ENV}, a as (select doc_id, pos::int as pos, json_extract(j, '$.amounts[' || pos || ']') as x from {items('$.amounts')}),
    b as (select doc_id, pos, {js('x', 'label')} as l, case when {js('x', 'text')} <> '' then {js('x', 'text')} else {js('x', 'value')} end as text, nullif({js('x', 'unit')}, '') as unit,
      coalesce(json_extract_string(x, '$.is_installment') = 'true', false) as is_installment, coalesce(json_extract_string(x, '$.is_total_component') = 'true', false) as t from a where json_type(x) = 'OBJECT')
    select doc_id, pos, case when l = '' then '金额' else l end as label, text, unit, is_installment, t and unit is null and not is_installment as is_total_component from b where text <> ''""",
)
def envelope_amounts(spark: SparkSession, d: str) -> DataFrame:
    return R.envelope_amounts(envelopes(spark, d), "v", "doc_id").drop("value")


@query("envelope_amount_values")
def envelope_amount_values(spark: SparkSession, d: str) -> DataFrame:
    return R.envelope_amounts(envelopes(spark, d), "v", "doc_id").select("doc_id", "pos", "text", "value")


@query(
    "children_obligations",
    f"""with {ENV}, a as (select doc_id, pos::int as ordering, json_extract(j, '$.obligations[' || pos || ']') as x from {items('$.obligations')})
    select doc_id, ordering, {js('x', 'actor')} as actor, substr({js('x', 'action')}, 1, 200) as action, json_extract_string(x, '$.deadline') as deadline from a
    where json_type(x) = 'OBJECT' and {js('x', 'actor')} in ('party_a', 'party_b', 'both') and {js('x', 'action')} <> ''""",
)
def children_obligations(spark: SparkSession, d: str) -> DataFrame:
    return R.envelope_obligations(envelopes(spark, d), "v", "doc_id").drop("evidence")


@query(
    "children_seals",
    f"""with {ENV}, own as (select doc_id, 0 as part, 0 as s, pos, json_extract(j, '$.seals[' || pos || ']') as x from {items('$.seals')}),
    subs as (select doc_id, pos as s, json_extract(j, '$.sub_agreements[' || pos || ']') as sub from {items('$.sub_agreements')}),
    more as (select doc_id, 1 as part, s, pos, json_extract(sub, '$.seals[' || pos || ']') as x from (select doc_id, s, sub, unnest(range(json_array_length(sub, '$.seals')::bigint)) as pos from subs where json_type(sub, '$.seals') = 'ARRAY')),
    every as (select * from own union all select * from more), ob as (select * from every where json_type(x) = 'OBJECT'),
    n as (select doc_id, (row_number() over (partition by doc_id order by part, s, pos) - 1)::int as ordering, x from ob)
    select doc_id, ordering, nullif({js('x', 'owner')}, '') as owner, nullif({js('x', 'seal_type')}, '') as seal_type, {js('x', 'raw_text')} as raw_text from n where {js('x', 'raw_text')} <> '' or {js('x', 'owner')} <> ''""",
)
def children_seals(spark: SparkSession, d: str) -> DataFrame:
    return R.envelope_seals(envelopes(spark, d), "v", "doc_id")


IDENT = f"""{ENV}, pe as (select doc_id, sha256, ingested_at, pos, json_extract(j, '$.person_identities[' || pos || ']') as x from {items('$.person_identities')}),
    ie as (select doc_id, sha256, ingested_at, pos, x, unnest(range(json_array_length(x, '$.identifiers')::bigint)) as ipos from pe where json_type(x) = 'OBJECT' and json_type(x, '$.identifiers') = 'ARRAY'),
    ident as (select doc_id, sha256, ingested_at, pos::int as pos, ipos::int as ipos, {js('x', 'name')} as name, nullif({js('x', 'role')}, '') as role, {js("json_extract(x, '$.identifiers[' || ipos || ']')", 'label')} as label,
      {js("json_extract(x, '$.identifiers[' || ipos || ']')", 'value')} as value from ie where json_type(json_extract(x, '$.identifiers[' || ipos || ']')) = 'OBJECT')"""


@query("envelope_identities", f"with {IDENT} select doc_id, pos, ipos, name, role, label, value from ident where name <> '' and label <> '' and value <> ''")
def envelope_identities(spark: SparkSession, d: str) -> DataFrame:
    return R.envelope_identities(envelopes(spark, d), "v", "doc_id")


@query(
    "completeness_status",
    f"""with {ENV}, iss as (select doc_id, count(*) as n from (select doc_id, json_extract(j, '$.completeness.issues[' || pos || ']') as x from {items('$.completeness.issues')}) where json_type(x) = 'OBJECT' and {js('x', 'item')} <> '' group by doc_id),
    s as (select env.doc_id, json_type(j, '$.completeness') = 'OBJECT' and {js('j', 'doc_type')} = '合同协议' as there, {js('j', 'completeness.status')} as st, coalesce(iss.n, 0)::int as n from env left join iss on iss.doc_id = env.doc_id)
    select doc_id, case when coalesce(there, false) then case when st not in ('complete', 'incomplete', 'unknown') then 'unknown' when st = 'complete' and n > 0 then 'incomplete' else st end end as status, case when coalesce(there, false) then n end as n_issues from s""",
)
def completeness_status(spark: SparkSession, d: str) -> DataFrame:
    return R.envelope_completeness(envelopes(spark, d), "v", "doc_id")


def half_even(total: str) -> str:
    """SQL of a decimal sum rounded half even to cents."""
    v = f"cast({total} * 1000000 as hugeint)"
    return f"cast(case when {v} % 10000 > 5000 or ({v} % 10000 = 5000 and ({v} // 10000) % 2 = 1) then {v} // 10000 + 1 else {v} // 10000 end as double) / 100"


AMT = "amt as (select distinct id, doc_id, label, value, unit, is_total_component, is_installment, ordering from labeled_amounts), tot as (select doc_id, " + half_even("sum(cast(value as decimal(24, 6)))") + " as total from amt where is_total_component and unit is null and not is_installment and value is not null group by doc_id)"


def amounts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labeled_amounts").select("id", "doc_id", "label", "value", "unit", "is_total_component", "is_installment", "ordering").distinct()


@query("computed_total", f"with {AMT} select doc_id, total from tot")
def computed_total(spark: SparkSession, d: str) -> DataFrame:
    return R.computed_totals(amounts(spark, d))


@query(
    "amount_rule_a",
    f"""with {AMT}, ins as (select doc_id, round_even(sum(value), 2) as instalments, string_agg(label, '＋' order by ordering, id) as labels from amt where is_installment and value is not null group by doc_id)
    select ins.doc_id, instalments, labels, total, round_even(instalments - total, 2) as over from ins join tot using (doc_id) where total > 0 and round_even(instalments - total, 2) > greatest(1.0, abs(total) * 0.01)""",
)
def amount_rule_a(spark: SparkSession, d: str) -> DataFrame:
    return R.overshooting_instalments(amounts(spark, d))


@query("amount_rule_b", f"with {AMT} select id, doc_id, label, value, total from amt join tot using (doc_id) where not is_total_component and not is_installment and unit is null and value is not null and total > 0 and value > total + greatest(1.0, abs(total) * 0.01)")
def amount_rule_b(spark: SparkSession, d: str) -> DataFrame:
    return R.overshooting_items(amounts(spark, d)).select("id", "doc_id", "label", "value", "total")


@query("area_prices", f"with {AMT} select doc_id, round_even(sum(value), 4) as price, count(*) as n from amt where value is not null and regexp_matches(unit, '㎡|平方米|平米|m²') and contains(unit, '月') group by doc_id")
def area_prices(spark: SparkSession, d: str) -> DataFrame:
    return amounts(spark, d).where("value is not null").where(R.is_area_month("unit")).groupBy("doc_id").agg(F.bround(F.sum("value"), 4).alias("price"), F.count("*").alias("n"))


@query(
    "names_in_text",
    rf"""with {IDENT}, who as (select distinct doc_id, pos, name from ident where name <> ''), txt as (select distinct doc_id, regexp_replace(raw_text, '[\s　]+', '', 'g') as t from pipeline_outputs)
    select who.doc_id, pos, name from who left join txt on txt.doc_id = who.doc_id where coalesce(t, '') = '' or contains(t, regexp_replace(name, '[\s　]+', '', 'g'))""",
)
def names_in_text(spark: SparkSession, d: str) -> DataFrame:
    people = R.envelope_identities(envelopes(spark, d), "v", "doc_id").select("doc_id", "pos", "name").distinct()
    # An identity with unusable identifiers counts as well: names come from the list itself.
    return R.names_in_text(people, table(spark, d, "pipeline_outputs").select("doc_id", F.col("raw_text").alias("text")).distinct())


@query(
    "loose_json",
    """select distinct id, case when details_json is null or not regexp_matches(details_json, '[{]') then null when json_valid(details_json) then 'ok' else 'bad' end as state from archive_documents""",
)
def loose_json(spark: SparkSession, d: str) -> DataFrame:
    body = N.loose_json("details_json")
    state = F.when(F.col("details_json").contains("{"), F.when((body != "{}") | (N.ustrip("details_json") == "{}"), "ok").otherwise("bad"))
    return table(spark, d, "archive_documents").select("id", "details_json").distinct().select("id", state.alias("state"))


@query(
    "usage_totals",
    f"""with {ENV}, u as (select {js('j', 'doc_type')} as kind, try_cast(json_extract_string(j, '$.llm_usage.input_tokens') as bigint) as i, try_cast(json_extract_string(j, '$.llm_usage.output_tokens') as bigint) as o from env)
    select kind, sum(i)::bigint as input_tokens, sum(o)::bigint as output_tokens, count(*) filter (i is not null or o is not null) as answers from u group by kind""",
)
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    return R.usage_totals(envelopes(spark, d).withColumn("kind", R.text_of(F.col("v"), "$.doc_type")), "v", "kind")


_FILLED = "case when trim(coalesce({0}::varchar, ''), e' \\t\\n　') <> '' then {1} else 0 end"


@query(
    "confidences",
    f"""with t as (select distinct id, title, summary, contract_name, party_a, party_b, amount_text, sign_date, expire_date, auto_renewal, primary_date from archive_documents)
    select id, case when {_FILLED.format('title', 1)} = 0 and {_FILLED.format('summary', 1)} = 0 then 0.0 else least(0.9, round(0.5 + 0.1 * ({' + '.join(_FILLED.format(c, 1) for c in ('party_a', 'primary_date', 'amount_text', 'party_b'))}), 1)) end::double as envelope,
    round(({' + '.join(_FILLED.format(c, 0.7) for c in ('contract_name', 'party_a', 'party_b', 'amount_text', 'sign_date', 'expire_date', 'auto_renewal', 'summary'))}) / 8, 6)::double as contract from t""",
)
def confidences(spark: SparkSession, d: str) -> DataFrame:
    c = "id title summary contract_name party_a party_b amount_text sign_date expire_date auto_renewal primary_date".split()
    t = table(spark, d, "archive_documents").select(*c).distinct()
    x = F.col
    eight = [x(n) for n in "contract_name party_a party_b amount_text sign_date expire_date auto_renewal summary".split()]
    return t.select("id", R.envelope_confidence(x("title"), x("summary"), x("party_a"), x("primary_date"), x("amount_text"), x("party_b")).alias("envelope"), R.share_filled(0.7, *eight).alias("contract"))


@query(
    "envelope_text_fields",
    f"""with {ENV} select doc_id, {js('j', 'title')} as title, coalesce(json_array_length(j, '$.parties'), 0)::int as n_parties, case when json_type(j, '$.parties') = 'ARRAY' then array_to_string(list_filter(list_transform(from_json(json_extract(j, '$.parties'), '["VARCHAR"]'), lambda x: trim(x, e' \\t\\n　')), lambda x: x <> ''), '|') else '' end as parties from env""",
)
def envelope_text_fields(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    names = F.coalesce(R.member(v, "$.parties", "array<string>"), F.array().cast("array<string>"))
    clean = F.filter(F.transform(names, N.ustrip), lambda x: F.coalesce(x, F.lit("")) != "")
    return envelopes(spark, d).select("doc_id", R.text_of(v, "$.title").alias("title"), F.size(names).alias("n_parties"), F.array_join(clean, "|").alias("parties"))
