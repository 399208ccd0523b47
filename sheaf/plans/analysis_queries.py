"""Queries of fusion, registry and evaluation, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import normalise as N
from sheaf.operators import evaluation as E
from sheaf.operators import fusion as X
from sheaf.operators import records as R
from sheaf.operators import registry as G
from sheaf.plans.record_queries import ENV, IDENT, envelopes, items, js
from sheaf.plans.normal_queries import DATE
from sheaf.plans.registry import query
from sheaf.sources.tables import table

_V = "lower(replace(replace(trim(value, e' \\t\\n　'), ' ', ''), '　', ''))"
_J = _V
for _w in N.CURRENCY_JUNK:
    _J = f"replace({_J}, '{_w}', '')"
_J = f"replace({_J}, '万元', '万')"
FUSED = f"case when regexp_matches({_V}, '[0-9]') then case when regexp_full_match({_J}, '[0-9]+个?月') and cast(regexp_extract({_J}, '[0-9]+') as bigint) % 12 = 0 then (cast(regexp_extract({_J}, '[0-9]+') as bigint) // 12) || '年' else {_J} end else {_V} end"
#: Candidates of a field: the verdict's own value as its source, then the other candidates.
CAND = f"""{ENV}, fv as (select doc_id, pos, json_extract(j, '$.field_verdicts[' || pos || ']') as x from {items('$.field_verdicts')}), fo as (select * from fv where json_type(x) = 'OBJECT'),
    fc as (select doc_id, x, unnest(range(json_array_length(x, '$.candidates')::bigint)) as cp from fo where json_type(x, '$.candidates') = 'ARRAY'),
    cand as (select doc_id, {js('x', 'key')} as key, {js('x', 'source')} as source, -1 as pos, json_extract_string(x, '$.value') as value from fo
      union all select doc_id, {js('x', 'key')}, {js("json_extract(x, '$.candidates[' || cp || ']')", 'source')}, cp::int, json_extract_string(x, '$.candidates[' || cp || '].value') from fc),
    ranked as (select *, case source when 'text' then 0 when 'vision' then 1 else 9 end as o, {FUSED} as norm from cand),
    agg as (select doc_id, key, count(distinct source) as n_sources, count(distinct case when coalesce(value, '') <> '' then norm end) as n_values,
      (min(struct_pack(o := o, pos := pos, value := value)) filter (coalesce(value, '') <> '')).value as first_value, (min(struct_pack(pos := pos, value := value)) filter (coalesce(value, '') <> '' and source = 'vision')).value as vision_value,
      min(struct_pack(o := o, source := source)).source as first_source from ranked group by doc_id, key)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    base = R.exploded(envelopes(spark, d), "v", "$.field_verdicts", "doc_id")
    own = base.select("doc_id", R.text_of(x, "$.key").alias("key"), R.text_of(x, "$.source").alias("source"), F.lit(-1).alias("pos"), R.member(x, "$.value").alias("value"))
    rest = base.select("doc_id", R.text_of(x, "$.key").alias("key"), F.posexplode(R.member(x, "$.candidates", "array<variant>")).alias("pos", "y"))
    rest = rest.select("doc_id", "key", R.text_of(y, "$.source").alias("source"), "pos", R.member(y, "$.value").alias("value"))
    return own.unionByName(rest)


@query("fusion_agree", f"with {CAND} select doc_id, key, n_sources, n_values, n_values = 1 as agree from agg")
def fusion_agree(spark: SparkSession, d: str) -> DataFrame:
    return X.agreement(candidates(spark, d), "doc_id", "key").select("doc_id", "key", "n_sources", "n_values", (F.col("n_values") == 1).alias("agree"))


VERDICT = "case when n_values = 1 then first_value else coalesce(vision_value, first_value) end as value, case when n_values = 1 and n_sources > 1 then 'agreed' when n_values = 1 then first_source else 'adjudicated' end as source, case when n_values = 1 and n_sources > 1 then 0.95 when n_values = 1 then 0.7 else 0.4 end::double as confidence, n_values <> 1 as low_confidence"


@query("fusion_verdict", f"with {CAND} select doc_id, key, {VERDICT} from agg")
def fusion_verdict(spark: SparkSession, d: str) -> DataFrame:
    return X.verdicts(candidates(spark, d), "doc_id", "key")


@query("fusion_overall", f"with {CAND}, v as (select doc_id, {VERDICT} from agg) select doc_id, min(confidence) as overall from v group by doc_id")
def fusion_overall(spark: SparkSession, d: str) -> DataFrame:
    return X.overall(X.verdicts(candidates(spark, d), "doc_id", "key"), "doc_id")


def identities(spark: SparkSession, d: str) -> DataFrame:
    rows = R.envelope_identities(envelopes(spark, d, "ingested_at"), "v", "doc_id", "ingested_at")
    return rows.withColumn("seq", F.concat_ws("#", "ingested_at", F.lpad(F.col("doc_id").cast("string"), 12, "0")))


_CN = rf"regexp_replace(name, '^(?:{'|'.join(N.ROLE_PREFIXES)})(?:[\s　]*[:：、|/\\\-]+[\s　]*|[\s　]+)', '')"
_CV = r"regexp_replace({0}, '[\s　;；,，、:：.。\-—_／/]', '', 'g')"
FIRST = f"""{IDENT}, r as (select doc_id, pos, ipos, {_CN} as cname, label, value, ingested_at || '#' || lpad(doc_id::varchar, 12, '0') as seq from ident where name <> '' and label <> '' and value <> ''),
    b as (select *, first_value(value) over (partition by cname, label order by seq, pos, ipos) as base from r)"""


@query("registry_first_seen", f"with {FIRST} select doc_id, pos, ipos, cname, label, value, base, {_CV.format('base')} <> {_CV.format('value')} as conflict from b")
def registry_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return G.first_seen(identities(spark, d)).select("doc_id", "pos", "ipos", "cname", "label", "value", "base", "conflict")


@query("registry_reconcile")
def registry_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return G.reconcile(identities(spark, d))


@query(
    "group_by_value",
    f"""with {FIRST}, o as (select cname as canonical, label, value, min(seq) as seq from b group by cname, label, value), g as (select canonical, {_CV.format('value')} as cv, string_agg(label, '/' order by seq, label, value) as labels, first(value order by seq, label, value) as value from o group by canonical, cv)
    select canonical, labels, value from g""",
)
def group_by_value(spark: SparkSession, d: str) -> DataFrame:
    base = G.cleaned(identities(spark, d)).groupBy(F.col("cname").alias("canonical"), "label", "value").agg(F.min("seq").alias("seq"))
    return G.group_by_value(base)


_ISO = rf"case when regexp_matches(dt, '{DATE}') then regexp_extract(dt, '{DATE}', 1) || '-' || lpad(regexp_extract(dt, '{DATE}', 2), 2, '0') || '-' || lpad(regexp_extract(dt, '{DATE}', 3), 2, '0') else dt end"
ALIGN = rf"""{ENV}, pa as (select doc_id, pos::int as pos, json_extract(j, '$.key_dates[' || pos || ']') as x from {items('$.key_dates')}), pb as (select doc_id, pos, {js('x', 'label')} as l, nullif({js('x', 'date')}, '') as dt from pa where json_type(x) = 'OBJECT'),
    pred as (select doc_id, pos, case when l = '' then '日期' else l end as label, {_ISO} as c from pb where l <> '' or dt is not null), ga as (select distinct id, doc_id, trim(label, e' \t\n　') as label, date_text as dt, ordering from labeled_dates),
    gold as (select doc_id, ordering, id, label, {_ISO} as c from ga), g as (select *, row_number() over (partition by doc_id, label order by id) as k from gold), p as (select *, row_number() over (partition by doc_id, label order by pos) as k from pred),
    j2 as (select coalesce(g.doc_id, p.doc_id) as doc_id, g.doc_id is not null as ing, p.doc_id is not null as inp, g.c is not distinct from p.c as same from g full join p on g.doc_id = p.doc_id and g.label = p.label and g.k = p.k),
    s as (select doc_id, count(*) filter (ing and inp and same) as tp, count(*) filter (inp and not (ing and same)) as fp, count(*) filter (ing and not (inp and same)) as fn from j2 group by doc_id)"""


def date_scores(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "labeled_dates").select("id", "doc_id", N.ustrip("label").alias("label"), N.norm_date("date_text").alias("c")).distinct().withColumn("o", F.col("id"))
    pred = R.envelope_dates(envelopes(spark, d), "v", "doc_id").select("doc_id", "label", F.col("date").alias("c"), F.col("pos").alias("o"))
    return E.align_exact(gold, pred, "doc_id", "label", "o", "c")


@query("align_exact_scores", f"with {ALIGN} select doc_id, tp, fp, fn from s")
def align_exact_scores(spark: SparkSession, d: str) -> DataFrame:
    return date_scores(spark, d)


FB = "case when tp + fp + fn = 0 then 1.0 when {b} * (case when tp + fp > 0 then tp / (tp + fp) else 1.0 end) + (case when tp + fn > 0 then tp / (tp + fn) else 1.0 end) > 0 then (1 + {b}) * (case when tp + fp > 0 then tp / (tp + fp) else 1.0 end) * (case when tp + fn > 0 then tp / (tp + fn) else 1.0 end) / ({b} * (case when tp + fp > 0 then tp / (tp + fp) else 1.0 end) + (case when tp + fn > 0 then tp / (tp + fn) else 1.0 end)) else 0.0 end"


@query("fbeta_fields", f"with {ALIGN}, f as (select doc_id, tp::double as tp, fp::double as fp, fn::double as fn from s) select doc_id, round({FB.format(b='1.0')}, 9)::double as f1, round({FB.format(b='4.0')}, 9)::double as f2 from f")
def fbeta_fields(spark: SparkSession, d: str) -> DataFrame:
    return date_scores(spark, d).select("doc_id", F.round(E.fbeta("tp", "fp", "fn", 1.0), 9).alias("f1"), F.round(E.fbeta("tp", "fp", "fn", 2.0), 9).alias("f2"))


@query("micro_fbeta", f"with {ALIGN}, f as (select sum(tp)::double as tp, sum(fp)::double as fp, sum(fn)::double as fn from s) select tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round({FB.format(b='1.0')}, 9)::double as f, round(tp / (tp + fn), 9)::double as recall from f")
def micro_fbeta(spark: SparkSession, d: str) -> DataFrame:
    return E.micro(date_scores(spark, d)).select("tp", "fp", "fn", F.round("f", 9).alias("f"), F.round("recall", 9).alias("recall"))


@query(
    "weighted_score",
    f"""with {ALIGN}, t as (select doc_id, tp::double as tp, fp::double as fp, fn::double as fn, 1.0 as w, 1.0 as b from s union all select doc_id, tp, 0, fn, 3.0, 4.0 from s), f as (select doc_id, w, {FB.format(b='b')} as f from t) select doc_id, round(sum(f * w) / sum(w), 9)::double as score from f group by doc_id""",
)
def weighted_score(spark: SparkSession, d: str) -> DataFrame:
    s = date_scores(spark, d)
    both = s.withColumns({"weight": F.lit(1.0), "beta": F.lit(1.0)}).unionByName(s.withColumns({"fp": F.lit(0).cast("bigint"), "weight": F.lit(3.0), "beta": F.lit(2.0)}))
    return E.weighted(both, "doc_id").select("doc_id", F.round("score", 9).alias("score"))


@query("align_fuzzy_scores")
def align_fuzzy_scores(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "document_seals").select("id", "doc_id", F.lower(N.ws_free("raw_text")).alias("c")).distinct().withColumnRenamed("id", "o")
    pred = R.envelope_seals(envelopes(spark, d), "v", "doc_id").select("doc_id", F.col("ordering").alias("o"), F.lower(N.ws_free("raw_text")).alias("c"))
    return E.align_fuzzy(gold, pred, "doc_id", "o", "c")


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "archive_documents").select(F.col("id").alias("doc_id"), "status").distinct()
    scored = date_scores(spark, d).where("tp + fp + fn > 0").select("doc_id", E.fbeta("tp", "fp", "fn").alias("f")).join(types, "doc_id")
    return E.bootstrap_by(scored, "status", "f")


RUNS = "runs as (select distinct doc_id, coalesce(nullif(model, ''), 'none') as model, duration_seconds from pipeline_outputs)"


@query("latency_p50_p95", f"with {RUNS}, l as (select model, list_sort(list(duration_seconds)) as v from runs where duration_seconds is not null group by model) select model, len(v)::bigint as n, list_aggregate(v, 'median')::double as p50, v[least(len(v), len(v) * 95 // 100 + 1)] as p95 from l")
def latency_p50_p95(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "pipeline_outputs").select("doc_id", F.coalesce(F.nullif("model", F.lit("")), F.lit("none")).alias("model"), "duration_seconds").distinct()
    return E.latency(runs, "model", "duration_seconds")


@query("first_runs", "with t as (select distinct event_id, user_id, event_type, ts, value from events), n as (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as k, count(*) over (partition by user_id, event_type) as runs from t) select user_id, event_type, event_id, value, runs > 1 as repeated from n where k = 1")
def first_runs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value").distinct()
    n = t.groupBy("user_id", "event_type").agg((F.count("*") > 1).alias("repeated"))
    return E.first_runs(t, "user_id", "event_type", order=("ts", "event_id")).join(n, ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "value", "repeated")


SIDES = f"a as (select distinct {_CV.format('party_a')} as k from archive_documents where party_a is not null), b as (select distinct {_CV.format('owner')} as k from document_seals where owner is not null)"


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    key = lambda t, c: table(spark, d, t).where(F.col(c).isNotNull()).select(N.canon_value(c).alias("k")).distinct()
    return key("archive_documents", "party_a"), key("document_seals", "owner")


@query("blind_diff_only_a", f"with {SIDES} select k from a except select k from b")
def blind_diff_only_a(spark: SparkSession, d: str) -> DataFrame:
    a, b = sides(spark, d)
    return E.only_in(a, b, "k")


@query("blind_diff_only_b", f"with {SIDES} select k from b except select k from a")
def blind_diff_only_b(spark: SparkSession, d: str) -> DataFrame:
    a, b = sides(spark, d)
    return E.only_in(b, a, "k")


@query("blind_diff_both", f"with {SIDES} select k from a intersect select k from b")
def blind_diff_both(spark: SparkSession, d: str) -> DataFrame:
    a, b = sides(spark, d)
    return a.join(b, "k", "left_semi")


@query(
    "signer_mismatch",
    r"""with p as (select distinct id as doc_id, party_a, party_b from archive_documents), s as (select distinct doc_id, regexp_replace(owner, '[\s　]+', '', 'g') as n, owner from document_seals where owner is not null),
    j as (select s.doc_id, s.owner as signer, n, regexp_replace(coalesce(party_a, ''), '[\s　]+', '', 'g') as a, regexp_replace(coalesce(party_b, ''), '[\s　]+', '', 'g') as b from s join p using (doc_id))
    select doc_id, signer from j where (a <> '' or b <> '') and n <> '' and not (a <> '' and (contains(a, n) or contains(n, a))) and not (b <> '' and (contains(b, n) or contains(n, b)))""",
)
def signer_mismatch(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "archive_documents").select(F.col("id").alias("doc_id"), F.filter(F.array("party_a", "party_b"), lambda x: F.coalesce(x, F.lit("")) != "").alias("parties")).distinct()
    signers = table(spark, d, "document_seals").where("owner is not null").select("doc_id", F.col("owner").alias("signer")).distinct()
    return X.signer_mismatches(signers, docs, "doc_id").select("doc_id", "signer")


@query(
    "seal_issues",
    f"""with u as (select distinct doc_id, ordering, coalesce(seal_type, '') as agreement, trim(coalesce(owner, ''), e' \\t\\n　') as role, ordering as page, raw_text <> '' and length(raw_text) > 6 as has_seal from document_seals)
    select doc_id, (case when trim(agreement, e' \\t\\n　') = '' then '协议' else trim(agreement, e' \\t\\n　') end) || '·' || role || '签章' as item, 'signature' as category, '据落款页图：第 ' || page || ' 页' as evidence from u where role <> '' and not has_seal""",
)
def seal_issues(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "document_seals").select(
        "doc_id", "ordering", F.coalesce("seal_type", F.lit("")).alias("agreement"), N.ustrip(F.coalesce("owner", F.lit(""))).alias("role"), F.col("ordering").alias("page"), ((F.col("raw_text") != "") & (F.length("raw_text") > 6)).alias("has_seal"), F.lit(False).alias("has_signature")
    )
    return X.seal_issues(units.distinct(), "doc_id")


@query(
    "scalar_scores",
    f"""with {ENV}, g as (select distinct id as doc_id, title, doc_type from archive_documents), b as (select g.doc_id, nullif(title, '') as gt, nullif({js('j', 'title')}, '') as pt, nullif(doc_type, '') as gd, nullif({js('j', 'doc_type')}, '') as pd from g join env using (doc_id)),
    s as (select doc_id, 'title' as field, gt as g, pt as p from b union all select doc_id, 'doc_type', gd, pd from b), r as (select field, g is not null and g = coalesce(p, '') as ok, g, p from s)
    select field, sum(ok::int)::bigint as tp, sum((not ok and p is not null)::int)::bigint as fp, sum((not ok and g is not null)::int)::bigint as fn from r group by field""",
)
def scalar_scores(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "archive_documents").select(F.col("id").alias("doc_id"), "title", "doc_type").distinct()
    both = gold.join(envelopes(spark, d), "doc_id")
    fields = F.array(*(F.struct(F.lit(c).alias("field"), E.score_scalar(F.col(c), R.text_of(F.col("v"), f"$.{c}")).alias("s")) for c in ("title", "doc_type")))
    rows = both.select(F.explode(fields).alias("x")).select("x.field", "x.s.*")
    return rows.groupBy("field").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


@query("verdict_pages")
def verdict_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages the candidates of each verdict stand on."""
    x, y = F.col("x"), F.col("y")
    rest = R.exploded(envelopes(spark, d), "v", "$.field_verdicts", "doc_id").select("doc_id", R.text_of(x, "$.key").alias("key"), F.posexplode(R.member(x, "$.candidates", "array<variant>")).alias("pos", "y"))
    return X.distinct_pages(rest.select("doc_id", "key", "pos", R.member(y, "$.page", "int").alias("page")), "doc_id", "key")


@query("gate_measures")
def gate_measures(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap bounds of the two statuses' date scores, one held against the other."""
    m = bootstrap_ci(spark, d)
    side = lambda s: m.where(F.col("status") == s).select(F.lit("key_dates").alias("measure"), "mean", "low")
    return E.gate(side("ok"), side("partial"), 0.03, 0.98)
