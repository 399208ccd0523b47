"""Queries of the relational archive over the archive tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import archive as A
from sheaf.plans.registry import query
from sheaf.sources.tables import table

AS_OF = "2024-06-15"
DOC = "id, sha256, status, doc_type, title, contract_name, party_a, party_b, amount_cents, sign_date, expire_date, auto_renewal, completeness_status, ingested_at, primary_date, primary_amount_cents"
#: Exact copies of a row count once: the columns used are made distinct.
DOCS = f"docs as (select distinct {DOC} from archive_documents), obl as (select distinct id, doc_id, actor, action, deadline, ordering from obligations), seal as (select distinct id, doc_id, owner, seal_type, raw_text, ordering from document_seals), issue as (select distinct id, doc_id, category from completeness_issues)"
SUBJ = "subj as (select distinct doc_id, subject from (select id as doc_id, trim(party_a) as subject from docs union all select id, trim(party_b) from docs) where subject <> '')"
FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def documents(spark: SparkSession, d: str, columns: str = DOC) -> DataFrame:
    return table(spark, d, "archive_documents").select(*columns.split(", ")).distinct()


def child(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """A child table with its copies: for semi and anti joins and sets, which they don't change."""
    return table(spark, d, name).select(*columns)


OBL, SEALS, ISSUES = ("id", "doc_id", "actor", "action", "deadline", "ordering"), ("id", "doc_id", "owner", "seal_type", "raw_text", "ordering"), ("id", "doc_id", "category")


def obligations(spark: SparkSession, d: str) -> DataFrame:
    return child(spark, d, "obligations", *OBL).distinct()


def seals(spark: SparkSession, d: str) -> DataFrame:
    return child(spark, d, "document_seals", *SEALS).distinct()


def subjects(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "archive_documents").select(F.col("id").alias("doc_id"), F.explode(F.array("party_a", "party_b")).alias("subject"))
    return both.select("doc_id", F.trim("subject").alias("subject")).where("subject <> ''")


HIT = "id, contract_name, party_a, amount_cents, sign_date, ingested_at"


def _search(flt: A.SearchFilter):
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = A.search(documents(spark, d), flt, obligations=child(spark, d, "obligations", *OBL), seals=child(spark, d, "document_seals", *SEALS), subjects=subjects(spark, d), risks=child(spark, d, "completeness_issues", *ISSUES))
        return found.select(*HIT.split(", "))

    return run


def _sql(where: str, limit: int = 50) -> str:
    return f"with {DOCS}, {SUBJ} select {HIT} from docs where {where} order by ingested_at desc nulls last, id limit {limit}"


def _like(c: str, kw: str) -> str:
    return f"{FOLD.format(c)} like '%{kw}%'"


SEARCHES = {
    "search_like_range": (A.SearchFilter(name="合同", amount_min=1_000_000, signed_after="2016-01-01"), f"{_like('contract_name', '合同')} and amount_cents >= 1000000 and sign_date >= '2016-01-01'"),
    "search_party_wildcard": (A.SearchFilter(party="市%科技", limit=100), f"({_like('party_a', '市%科技')} or {_like('party_b', '市%科技')})"),
    "search_party_ascii_case": (A.SearchFilter(party="TRADING co", limit=100), f"({_like('party_a', 'trading co')} or {_like('party_b', 'trading co')})"),
    "search_amount_between": (A.SearchFilter(amount_min=0, amount_max=50_000_000, signed_before="2022-12-31"), "amount_cents >= 0 and amount_cents <= 50000000 and sign_date <= '2022-12-31'"),
    "search_expire_renewal": (A.SearchFilter(expire_before="2030-01-01", auto_renewal=True), "expire_date <= '2030-01-01' and auto_renewal = 1"),
    "search_not_renewal_status": (A.SearchFilter(auto_renewal=False, status="ok"), "auto_renewal = 0 and status = 'ok'"),
    "search_exists_same_row": (
        A.SearchFilter(obligation_after="2025-01-01", obligation_before="2026-06-30", obligation_actor="party_b"),
        "exists (select 1 from obl o where o.doc_id = docs.id and o.deadline >= '2025-01-01' and o.deadline <= '2026-06-30' and o.actor = 'party_b')",
    ),
    "search_has_seal": (A.SearchFilter(has_seal=True), "exists (select 1 from seal s where s.doc_id = docs.id)"),
    "search_no_seal": (A.SearchFilter(has_seal=False), "not exists (select 1 from seal s where s.doc_id = docs.id)"),
    "search_seal_owner_type": (A.SearchFilter(seal_owner="置业", seal_type="合同专用章"), f"exists (select 1 from seal s where s.doc_id = docs.id and {_like('s.owner', '置业')} and {_like('s.seal_type', '合同专用章')})"),
    "search_subject": (A.SearchFilter(subject="物业"), f"exists (select 1 from subj s where s.doc_id = docs.id and {_like('s.subject', '物业')})"),
    "search_has_risk": (A.SearchFilter(has_risk=True), "exists (select 1 from issue i where i.doc_id = docs.id)"),
    "search_incomplete_type": (A.SearchFilter(incomplete=True, doc_type="合同协议"), "completeness_status = 'incomplete' and doc_type = '合同协议'"),
    "search_all_predicates": (
        A.SearchFilter(party="公司", amount_min=0, signed_after="2014-01-01", signed_before="2026-01-01", has_risk=True, has_seal=True, seal_type="章", obligation_after="2020-01-01", subject="公司", doc_type="合同协议", status="ok", incomplete=True),
        f"({_like('party_a', '公司')} or {_like('party_b', '公司')}) and amount_cents >= 0 and sign_date >= '2014-01-01' and sign_date <= '2026-01-01' and doc_type = '合同协议' and status = 'ok' and completeness_status = 'incomplete'"
        f" and exists (select 1 from issue i where i.doc_id = docs.id) and exists (select 1 from seal s where s.doc_id = docs.id) and exists (select 1 from seal s where s.doc_id = docs.id and {_like('s.seal_type', '章')})"
        f" and exists (select 1 from obl o where o.doc_id = docs.id and o.deadline >= '2020-01-01') and exists (select 1 from subj s where s.doc_id = docs.id and {_like('s.subject', '公司')})",
    ),
}
for _name, (_flt, _where) in SEARCHES.items():
    query(_name, _sql(_where, _flt.limit))(_search(_flt))

for _c in A.ORDER_COLUMNS:

    @query(f"list_top_{_c}", f"with {DOCS} select id, {_c} as sort_value from docs order by {_c} desc nulls last, id limit 50")
    def _list(spark: SparkSession, d: str, c: str = _c) -> DataFrame:
        return A.list_documents(documents(spark, d), order_by=c).select("id", F.col(c).alias("sort_value"))


@query("list_incomplete", f"with {DOCS} select {HIT} from docs where status = 'ok' and completeness_status = 'incomplete' order by ingested_at desc nulls last, id limit 20")
def list_incomplete(spark: SparkSession, d: str) -> DataFrame:
    return A.list_documents(documents(spark, d), limit=20, status="ok", incomplete=True).select(*HIT.split(", "))


TODO = "o.id as obligation_id, o.doc_id, o.actor, o.action, o.deadline, o.ordering, d.contract_name, d.title, d.party_a, d.party_b from obl o join docs d on d.id = o.doc_id"
TODO_ORDER = "order by o.deadline is null, o.deadline, o.doc_id, o.ordering, o.id limit 50"


@query("todo_board", f"with {DOCS} select {TODO} where o.deadline is not null {TODO_ORDER}")
def todo_board(spark: SparkSession, d: str) -> DataFrame:
    return A.todo(obligations(spark, d), documents(spark, d))


@query("todo_with_undated", f"with {DOCS} select {TODO} where o.actor = 'party_a' and (o.deadline is null or o.deadline >= '2028-01-01') {TODO_ORDER}")
def todo_with_undated(spark: SparkSession, d: str) -> DataFrame:
    return A.todo(obligations(spark, d), documents(spark, d), actor="party_a", after="2028-01-01", include_undated=True)


@query("todo_within_days", f"with {DOCS} select {TODO} where o.deadline >= '{AS_OF}' and o.deadline <= strftime(date '{AS_OF}' + interval 90 day, '%Y-%m-%d') {TODO_ORDER}")
def todo_within_days(spark: SparkSession, d: str) -> DataFrame:
    return A.todo(obligations(spark, d), documents(spark, d), after=AS_OF, before="2024-09-13")


SEAL = "s.id as seal_id, s.doc_id, s.owner, s.seal_type, s.raw_text, s.ordering, coalesce(d.title, d.contract_name) as doc_title from seal s join docs d on d.id = s.doc_id"
SEAL_ORDER = "order by s.owner asc nulls last, s.seal_type asc nulls first, s.doc_id, s.ordering, s.id limit 200"


@query("seal_board", f"with {DOCS} select {SEAL} {SEAL_ORDER}")
def seal_board(spark: SparkSession, d: str) -> DataFrame:
    return A.seal_board(seals(spark, d), documents(spark, d))


@query("seal_board_filtered", f"with {DOCS} select {SEAL} where {_like('s.owner', 'co')} and {_like('s.seal_type', '章')} {SEAL_ORDER}")
def seal_board_filtered(spark: SparkSession, d: str) -> DataFrame:
    return A.seal_board(seals(spark, d), documents(spark, d), owner="CO", seal_type="章")


FLAT = "concat_ws('|', actor, action, coalesce(deadline, '-'))"


@query(
    "hydrate_documents",
    f"""with {DOCS}, o as (select doc_id, string_agg({FLAT}, ';' order by ordering, id) as x, count(*) as n from obl group by doc_id), s as (select doc_id, count(*) as n from seal group by doc_id)
    select docs.id, docs.status, coalesce(o.x, '') as obligations, coalesce(o.n, 0) as n_obligations, coalesce(s.n, 0) as n_seals from docs left join o on o.doc_id = docs.id left join s on s.doc_id = docs.id""",
)
def hydrate_documents(spark: SparkSession, d: str) -> DataFrame:
    # The key is unique once copies are dropped, and dropped by the key the rows are already where the joins need them.
    docs = table(spark, d, "archive_documents").select("id", "status").dropDuplicates(["id"])
    full = A.hydrate(docs, child(spark, d, "obligations", *OBL), child(spark, d, "document_seals", *SEALS))
    text = F.array_join(F.transform("obligations", lambda x: F.concat_ws("|", x["actor"], x["action"], F.coalesce(x["deadline"], F.lit("-")))), ";")
    return full.select("id", "status", text.alias("obligations"), F.size("obligations").cast("bigint").alias("n_obligations"), F.size("seals").cast("bigint").alias("n_seals"))


@query("resolve_by_id", f"with {DOCS} select id, sha256 from docs where id = 17")
def resolve_by_id(spark: SparkSession, d: str) -> DataFrame:
    return A.resolve(documents(spark, d), "17").select("id", "sha256")


@query("resolve_by_prefix", f"with {DOCS}, hit as (select id, sha256 from docs where starts_with(sha256, '1f8a19')) select id, sha256 from hit where (select count(*) from hit) = 1")
def resolve_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    return A.resolve(documents(spark, d), "1F8A19").select("id", "sha256")


@query("prefix_lookup", f"with {DOCS} select id, sha256 from docs where starts_with(sha256, (select substr(min(sha256), 1, 4) from docs))")
def prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every match of the first four characters of the smallest hash."""
    prefix = documents(spark, d).agg(F.min("sha256")).head()[0]
    return A.by_prefix(documents(spark, d), prefix[:4]).select("id", "sha256")


@query("stats_status", f"with {DOCS} select status, count(*) as n from docs group by status")
def stats_status(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, "id, status").groupBy("status").agg(F.count("*").alias("n"))


@query("stats_sign_month", f"with {DOCS} select substr(sign_date, 1, 7) as month, count(*) as n from docs where sign_date is not null group by 1")
def stats_sign_month(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, "id, sign_date").where("sign_date is not null").groupBy(F.substring("sign_date", 1, 7).alias("month")).agg(F.count("*").alias("n"))


@query(
    "stats_all",
    f"""with {DOCS} select (select count(*) from docs) as total, (select count(*) from docs where ingested_at like '{AS_OF[:7]}%') as new_this_month,
    (select count(*) from docs where expire_date >= '{AS_OF}' and expire_date <= strftime(date '{AS_OF}' + interval 30 day, '%Y-%m-%d')) as expiring_within_30d,
    (select string_agg(status || '=' || n, ',' order by status) from (select status, count(*) as n from docs group by status)) as by_status,
    (select string_agg(month || '=' || n, ',' order by month) from (select substr(sign_date, 1, 7) as month, count(*) as n from docs where sign_date is not null group by 1)) as by_sign_month""",
)
def stats_all(spark: SparkSession, d: str) -> DataFrame:
    s = A.stats(documents(spark, d), AS_OF)
    flat = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return s.select("total", "new_this_month", "expiring_within_30d", flat("by_status").alias("by_status"), flat("by_sign_month").alias("by_sign_month"))


@query(
    "subject_labels",
    f"with {DOCS}, t as (select id, concat_ws('、', party_a, party_b) as s from docs) select id, case when length(s) > 20 then substr(s, 1, 19) || '…' else s end as subject from t",
)
def subject_labels(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("id", A.subject_label(F.array().cast("array<string>"), F.col("party_a"), F.col("party_b")).alias("subject"))


@query(
    "display_columns",
    f"""with {DOCS} select id, case completeness_status when 'complete' then '✓' when 'incomplete' then '✗' when 'unknown' then '?' else '' end as mark,
    primary_amount_cents // 100 as yuan, replace(replace(ingested_at, 'T', ' '), 'Z', '') as shown_at, substr(sha256, 1, 12) as short_sha, 'documents/' || substr(sha256, 1, 12) || '/source.pdf' as source_path from docs""",
)
def display_columns(spark: SparkSession, d: str) -> DataFrame:
    mark = F.when(F.col("completeness_status") == "complete", "✓").when(F.col("completeness_status") == "incomplete", "✗").when(F.col("completeness_status") == "unknown", "?").otherwise("")
    at = F.coalesce(F.date_format(F.try_to_timestamp("ingested_at", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")), "yyyy-MM-dd HH:mm:ss"), "ingested_at")
    short = F.substring("sha256", 1, 12)
    return documents(spark, d).select(
        "id", mark.alias("mark"), F.expr("primary_amount_cents div 100").alias("yuan"), at.alias("shown_at"), short.alias("short_sha"), F.concat_ws("/", F.lit("documents"), short, F.lit("source.pdf")).alias("source_path")
    )


@query(
    "search_flagship",
    f"""with {DOCS}, o as (select doc_id, string_agg({FLAT}, ';' order by ordering, id) as x from obl group by doc_id),
    hit as (select * from docs where amount_cents >= 100000 and sign_date >= '2015-01-01' and {_like('contract_name', '合同')} and exists (select 1 from obl where obl.doc_id = docs.id and deadline >= '2024-01-01' and actor = 'party_b')
      and not exists (select 1 from seal where seal.doc_id = docs.id and {_like('seal_type', '公章')}) order by sign_date desc, id limit 50)
    select hit.id, hit.contract_name, hit.amount_cents, hit.sign_date, coalesce(o.x, '') as obligations from hit left join o on o.doc_id = hit.id""",
)
def search_flagship(spark: SparkSession, d: str) -> DataFrame:
    """Range, LIKE, same-row semi join, anti join, top-k, then the hits' children as arrays."""
    flt = A.SearchFilter(name="合同", amount_min=100_000, signed_after="2015-01-01", obligation_after="2024-01-01", obligation_actor="party_b")
    obl, seal = child(spark, d, "obligations", *OBL), child(spark, d, "document_seals", *SEALS)
    hits = A.matching(documents(spark, d), flt, obligations=obl).join(seal.where(A.ascii_like("seal_type", "公章")).select(F.col("doc_id").alias("id")), "id", "left_anti")
    hits = hits.orderBy(F.col("sign_date").desc(), "id").limit(50).select("id", "contract_name", "amount_cents", "sign_date")
    text = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("ordering", "oid", "flat"))), lambda x: x["flat"]), ";")
    flat = obl.select("doc_id", "ordering", F.col("id").alias("oid"), F.concat_ws("|", "actor", "action", F.coalesce("deadline", F.lit("-"))).alias("flat"))
    mine = flat.join(F.broadcast(hits.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi").groupBy("doc_id").agg(text.alias("obligations"))  # at most 50 keys
    return hits.join(mine, hits["id"] == mine["doc_id"], "left").select("id", "contract_name", "amount_cents", "sign_date", F.coalesce("obligations", F.lit("")).alias("obligations"))
