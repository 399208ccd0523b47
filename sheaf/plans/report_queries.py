"""Queries of run measures, displays and completions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import normalise as N
from sheaf.operators import reports as P
from sheaf.plans import analysis_queries  # noqa: F401  (fusion_overall)
from sheaf.plans.registry import QUERIES, SQL, query
from sheaf.sources.tables import table

#: Prices a million tokens of some models of the runs (assumed), and of all others.
PRICES = (("alpha", 2.5, 10.0), ("beta", 0.8, 4.8))
DEFAULT_PRICE = (1.0, 2.0)
RUNS = "runs as (select distinct model, doc_id, length(raw_text) as input_tokens, nullif(length(markdown), 0) as output_tokens from pipeline_outputs)"
COSTS = f"""{RUNS}, named as (select model, row_number() over (order by model) as n from (select distinct model from runs where model is not null)),
    prices as (select model, case n when 1 then {PRICES[0][1]} else {PRICES[1][1]} end as price_in, case n when 1 then {PRICES[0][2]} else {PRICES[1][2]} end as price_out from named where n <= 2),
    costs as (select r.*, case when input_tokens is not null or output_tokens is not null then coalesce(input_tokens, 0) / 1e6 * coalesce(price_in, {DEFAULT_PRICE[0]}) + coalesce(output_tokens, 0) / 1e6 * coalesce(price_out, {DEFAULT_PRICE[1]}) end as cost from runs r left join prices using (model))"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pipeline_outputs").select("model", "doc_id", F.length("raw_text").alias("input_tokens"), F.nullif(F.length("markdown"), F.lit(0)).alias("output_tokens")).distinct()


def costed(spark: SparkSession, d: str) -> DataFrame:
    """Runs with their cost; the first two models by name have a price of their own."""
    mine = runs(spark, d)
    two = mine.where("model is not null").select("model").distinct().orderBy("model").limit(2).agg(F.array_sort(F.collect_list("model")).alias("m")).select(F.posexplode("m").alias("n", "model"))
    first = F.col("n") == 0
    prices = two.select("model", F.when(first, PRICES[0][1]).otherwise(PRICES[1][1]).alias("price_in"), F.when(first, PRICES[0][2]).otherwise(PRICES[1][2]).alias("price_out"))
    return P.costs(mine, prices, DEFAULT_PRICE)


@query("run_costs", f"with {COSTS} select model, doc_id, round(cost, 9) as cost from costs")
def run_costs(spark: SparkSession, d: str) -> DataFrame:
    return costed(spark, d).select("model", "doc_id", F.round("cost", 9).alias("cost"))


@query(
    "run_measures",
    f"""with {COSTS}, sig as (select doc_id, count(*) filter (owner is not null) as sig_tp, count(*) filter (owner is null) as sig_fn from (select distinct id, doc_id, owner from document_seals) group by doc_id)
    select model, round(avg(case when output_tokens is not null then 1 else 0 end), 9) as parse_rate, round(avg(cost) * 1000, 6) as cost_per_1k,
      round(case when coalesce(sum(sig_tp), 0) + coalesce(sum(sig_fn), 0) > 0 then coalesce(sum(sig_tp), 0) / (coalesce(sum(sig_tp), 0) + coalesce(sum(sig_fn), 0)) end, 9) as sig_recall from costs left join sig using (doc_id) group by model""",
)
def run_measures(spark: SparkSession, d: str) -> DataFrame:
    seals = table(spark, d, "document_seals").select("id", "doc_id", "owner").distinct().groupBy("doc_id").agg(F.count_if(F.col("owner").isNotNull()).alias("sig_tp"), F.count_if(F.col("owner").isNull()).alias("sig_fn"))
    m = P.run_measures(costed(spark, d).withColumn("parse_ok", F.col("output_tokens").isNotNull()).join(seals, "doc_id", "left"))
    return m.select("model", F.round("parse_rate", 9).alias("parse_rate"), F.round("cost_per_1k", 6).alias("cost_per_1k"), F.round("sig_recall", 9).alias("sig_recall"))


@query(
    "run_determinism",
    "with l as (select distinct ts, op, doc_id, status from ingest_log) select op, doc_id, count(distinct coalesce(status, '<null>')) = 1 as same from l group by op, doc_id having count(*) > 1",
)
def run_determinism(spark: SparkSession, d: str) -> DataFrame:
    return P.determinism(table(spark, d, "ingest_log").select("ts", "op", "doc_id", "status").distinct(), "op", "doc_id", "status")


@query(
    "report_order",
    "with f as (select model, min(doc_id) as line from pipeline_outputs group by model), c as (select max(model) as champion from f) select model, (row_number() over (order by model <> champion, line, model) - 1)::int as place from f, c",
)
def report_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pipeline_outputs").select("model", "doc_id")
    return P.champion_first(rows, "model", "doc_id", rows.agg(F.max("model")).head()[0])


_MONEY = "'¥' || format('{:,}', cast(round_even(%s, 0) as bigint))"


@query("amount_display", f"select distinct id, case when amount_cents is not null then {_MONEY % 'amount_cents / 100'} || '*' when primary_amount_cents is not null then {_MONEY % 'primary_amount_cents / 100'} else '-' end as shown from archive_documents")
def amount_display(spark: SparkSession, d: str) -> DataFrame:
    yuan = lambda c: F.col(c).cast("decimal(20,0)") / 100
    return table(spark, d, "archive_documents").select("id", P.amount_display(yuan("amount_cents"), yuan("primary_amount_cents")).alias("shown")).distinct()


@query(
    "period_labels",
    "select distinct id, case when coalesce(period_start, '') = '' and coalesce(period_end, '') = '' then '' else ' [' || coalesce(nullif(period_start, ''), '?') || '~' || coalesce(nullif(period_end, ''), '?') || ']' end as label from labeled_amounts",
)
def period_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labeled_amounts").select("id", P.period_label("period_start", "period_end").alias("label")).distinct()


@query("document_texts", "select distinct doc_id, coalesce(raw_text, markdown, '') as text from pipeline_outputs")
def document_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pipeline_outputs").select("doc_id", P.document_text("raw_text", "markdown").alias("text")).distinct()


@query("markdown_unescaped", r"select distinct doc_id, regexp_replace(regexp_replace(markdown, '\\\\([-_*\[\]()#+.!`])', '\\1', 'g'), '_+', ' ', 'g') as text from pipeline_outputs".replace("\\\\", "\\"))
def markdown_unescaped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pipeline_outputs").select("doc_id", P.unescape_markdown("markdown").alias("text")).distinct()


@query(
    "legends",
    "select distinct id, array_to_string(list_filter([case when party_a is not null then 'party' end, case when amount_text is not null then 'amount' end, case when sign_date is not null then 'date' end], lambda x: x is not null), '  ') as legend from archive_documents",
)
def legends(spark: SparkSession, d: str) -> DataFrame:
    used = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(k)) for c, k in (("sign_date", "date"), ("party_a", "party"), ("amount_text", "amount")))))
    return table(spark, d, "archive_documents").select("id", P.legend(used, ["party", "amount", "date"]).alias("legend")).distinct()


_PAGE = "try_cast(nullif(regexp_extract(evidence, '第\\s*([0-9]+)\\s*页', 1), '') as int)"


@query("evidence_page_lists", f"select doc_id, '据落款页图：第 ' || string_agg(p, '、' order by p) || ' 页' as evidence from (select distinct doc_id, {_PAGE} as p from completeness_issues) where p is not null group by doc_id".replace("string_agg(p,", "string_agg(p::varchar,"))
def evidence_page_lists(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "completeness_issues").select("doc_id", N.evidence_page("evidence").alias("p")).where("p is not null")
    return pages.groupBy("doc_id").agg(P.page_list(F.array_sort(F.collect_set("p"))).alias("evidence"))


@query(
    "candidate_lines",
    f"""select doc_id, string_agg('- [' || category || case when p is not null then '（第' || p || '页）' else '' end || '] ' || coalesce(item, '') || case when coalesce(evidence, '') <> '' then ' 证据：' || evidence else '' end, chr(10) order by id) as lines
    from (select distinct id, doc_id, category, item, evidence, {_PAGE} as p from completeness_issues where category is not null) group by doc_id""",
)
def candidate_lines(spark: SparkSession, d: str) -> DataFrame:
    issues = table(spark, d, "completeness_issues").where("category is not null").select("doc_id", F.col("id").alias("pos"), F.col("category").alias("source"), N.evidence_page("evidence").alias("page"), F.col("item").alias("value"), "evidence").distinct()
    return P.candidate_lines(issues, "doc_id")


_JUDGED = """looked as (select distinct doc_id from document_seals), found as (select distinct doc_id, seal_type as item, 'signature' as category, raw_text as evidence from document_seals where owner is null and seal_type is not null),
    issues as (select distinct id, doc_id, item, category, evidence from completeness_issues),
    judged as (select doc_id, item, category, evidence from issues where category is distinct from 'signature' union all select doc_id, item, category, evidence from issues where category = 'signature' and doc_id not in (select doc_id from looked) union all select * from found)"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    seals = table(spark, d, "document_seals").select("doc_id", F.when(F.col("owner").isNull(), F.col("seal_type")).alias("item"), F.lit("signature").alias("category"), "raw_text").select("doc_id", "item", "category", F.when(F.col("item").isNotNull(), F.col("raw_text")).alias("evidence")).distinct()
    issues = table(spark, d, "completeness_issues").select("id", "doc_id", "item", "category", "evidence").distinct().drop("id")
    return P.rejudged(issues, seals, "doc_id")


@query("issues_rejudged", f"with {_JUDGED} select * from judged")
def issues_rejudged(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d)


@query("status_rejudged", f"with {_JUDGED}, n as (select doc_id, count(*) as n_issues from judged group by doc_id) select id, case when coalesce(n_issues, 0) > 0 then 'incomplete' else completeness_status end as status, coalesce(n_issues, 0) as n_issues from (select distinct id, completeness_status from archive_documents) left join n on id = doc_id")
def status_rejudged(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "archive_documents").select(F.col("id").alias("doc_id"), "completeness_status").distinct()
    return P.status_after(docs, judged(spark, d), "doc_id", "completeness_status").withColumnRenamed("doc_id", "id")


@query(
    "confidence_gated",
    f"with o as ({SQL['fusion_overall']}) select id, case when doc_type = '保险凭证' and overall is not null then overall else confidence end as confidence, coalesce(doc_type = '保险凭证' and overall is not null and overall < 0.6, false) as escalate from (select distinct id, doc_type, overall_confidence as confidence from archive_documents) left join o on id = doc_id",
)
def confidence_gated(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "archive_documents").select(F.col("id").alias("doc_id"), "doc_type", F.col("overall_confidence").alias("confidence")).distinct()
    gated = P.gated_confidence(docs, QUERIES["fusion_overall"](spark, d), "doc_id")
    return gated.select(F.col("doc_id").alias("id"), "confidence", F.coalesce("escalate", F.lit(False)).alias("escalate"))


@query(
    "verdict_scores",
    """with p as (select distinct id, doc_id, label as key, date_text as norm from labeled_dates), g as (select * from p where id % 3 <> 0),
    gc as (select doc_id, key, norm, count(*) as g from g group by all), pc as (select doc_id, key, norm, count(*) as p from p group by all),
    h as (select gc.doc_id, sum(g) as gold, sum(least(g, coalesce(p, 0))) as tp from gc left join pc on gc.doc_id = pc.doc_id and gc.key = pc.key and gc.norm is not distinct from pc.norm and gc.key <> '' group by gc.doc_id)
    select h.doc_id, tp::bigint as tp, ((select count(*) from p where p.doc_id = h.doc_id) - tp)::bigint as fp, (gold - tp)::bigint as fn from h""",
)
def verdict_scores(spark: SparkSession, d: str) -> DataFrame:
    """Dates as verdicts: two thirds of them stand for the gold of all."""
    pred = table(spark, d, "labeled_dates").select("id", "doc_id", F.col("label").alias("key"), F.col("date_text").alias("norm")).distinct()
    return P.verdict_scores(pred.where("id % 3 <> 0"), pred, "doc_id")


@query("issue_likeness")
def issue_likeness(spark: SparkSession, d: str) -> DataFrame:
    """How well each issue of a document meets the ones after it."""
    issues = table(spark, d, "completeness_issues").select("id", "doc_id", "item", "category", "evidence").distinct()
    a, b = (issues.select("doc_id", *(F.col(c).alias(f"{side}_{c}") for c in ("id", "item", "category", "evidence"))) for side in "gp")
    pairs = a.join(b, "doc_id").where("g_id < p_id")
    name = lambda side: {c: f"{side}_{c}" for c in ("item", "category", "evidence")}
    return pairs.select("g_id", "p_id", P.issue_likeness(name("g"), name("p")).alias("likeness")).where("likeness > 0")


_HEADERS = "values ('5'), (' 2.5 '), ('Wed, 21 Oct'), (''), (null)"


@query("retry_after", "select * from (values ('5', 5.0::double), (' 2.5 ', 2.5), ('Wed, 21 Oct', null), ('', null), (null, null)) t(header, seconds)")
def retry_after(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"select * from ({_HEADERS}) t(header)").select("header", P.retry_after("header").alias("seconds"))


@query(
    "failure_infos",
    "select * from (values ('config', 'no key', 'CONFIG_MISSING', 'config', false), ('extract', 'empty', 'EXTRACT_EMPTY', 'validation', false), ('parse', 'exit 1', 'MINERU_FAILED', 'infra', false), ('other', 'x', null, null, false)) t(kind, message, code, category, retryable)",
)
def failure_infos(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql("select * from (values ('config', 'no key'), ('extract', 'empty'), ('parse', 'exit 1'), ('other', 'x')) t(kind, detail)")
    return rows.select("kind", P.failure("kind", "detail").alias("f")).select("kind", "f.message", "f.code", "f.category", "f.retryable")


@query(
    "date_branches",
    "select * from (values ('二〇二四年三月五日', '2024-03-05'), ('二零二四年十二月三十一日', '2024-12-31'), ('2025.3.5', '2025-03-05'), ('2024年二月3日', '2024-02-03'), ('去年', '去年'), ('', null), (null, null)) t(given, iso)",
)
def date_branches(spark: SparkSession, d: str) -> DataFrame:
    """Every branch of the date normaliser with its literal result."""
    return spark.sql("select * from (values ('二〇二四年三月五日'), ('二零二四年十二月三十一日'), ('2025.3.5'), ('2024年二月3日'), ('去年'), (''), (null)) t(given)").select("given", N.norm_date("given").alias("iso"))


@query(
    "money_branches",
    "select * from (values ('人民币壹仟贰佰叁拾肆万伍仟陆佰柒拾捌元整', 12345678.0::double), ('叁亿零伍万元', 300050000.0), ('拾元', 10.0), ('两百元', 200.0), ('伍元陆角柒分', 5.67), ('柒角', null), ('无', null), ('1,234.5万元', 12345000.0), ('3千元', 3000.0), (null, null)) t(given, yuan)",
)
def money_branches(spark: SparkSession, d: str) -> DataFrame:
    """Every branch of the money normaliser with its literal result."""
    return spark.sql("select * from (values ('人民币壹仟贰佰叁拾肆万伍仟陆佰柒拾捌元整'), ('叁亿零伍万元'), ('拾元'), ('两百元'), ('伍元陆角柒分'), ('柒角'), ('无'), ('1,234.5万元'), ('3千元'), (null)) t(given)").select("given", N.money("given").alias("yuan"))


@query(
    "error_branches",
    "select * from (values ('RateLimitError', null, null, 'RATE_LIMITED'), ('x', 401, null, 'AUTH_FAILED'), ('PermissionDeniedError', null, null, 'PERMISSION_DENIED'), ('x', 400, null, 'BAD_REQUEST'), ('ReadTimeout', null, null, 'TIMEOUT'), ('x', null, 'it Timed out', 'TIMEOUT'), ('x', 503, null, 'UPSTREAM_ERROR'), (null, null, null, 'UNKNOWN')) t(name, status, message, code)",
)
def error_branches(spark: SparkSession, d: str) -> DataFrame:
    """Every rule of the error classifier."""
    rows = spark.sql("select * from (values ('RateLimitError', cast(null as int), cast(null as string)), ('x', 401, null), ('PermissionDeniedError', null, null), ('x', 400, null), ('ReadTimeout', null, null), ('x', null, 'it Timed out'), ('x', 503, null), (null, null, null)) t(name, status, message)")
    return rows.withColumn("code", N.error_code("name", "status", "message"))


@query("bool_branches", "select * from (values ('true', true), (' 是 ', true), ('YES', true), ('1', true), ('False', false), ('否', false), ('no', false), ('0', false), ('maybe', null), (null, null)) t(given, flag)")
def bool_branches(spark: SparkSession, d: str) -> DataFrame:
    """Every word of the boolean coercion."""
    return spark.sql("select * from (values ('true'), (' 是 '), ('YES'), ('1'), ('False'), ('否'), ('no'), ('0'), ('maybe'), (null)) t(given)").select("given", N.coerce_bool("given").alias("flag"))
