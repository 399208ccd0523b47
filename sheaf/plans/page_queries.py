"""Queries of the write path and of page operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import pages as P
from sheaf.plans.archive_queries import DOCS, documents, obligations, seals
from sheaf.plans.registry import query
from sheaf.sources import store as S
from sheaf.sources.tables import table


@query("content_dedup", "with h as (select doc_id, sha256(text) as sha, row_number() over (partition by sha256(text) order by doc_id) as k from documents where text is not null) select doc_id, sha from h where k = 1")
def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each content: an aggregate, so a text held by a third of all rows is combined before the shuffle."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha")).groupBy("sha").agg(F.min("doc_id").alias("doc_id"))


@query(
    "dry_run_actions",
    f"""with {DOCS}, scan as (select sha as sha256, count(*) as lines from (select distinct ts, sha, op from ingest_log where sha is not null) group by sha), old as (select sha256, status from docs where ingested_at < '2024-01-01')
    select scan.sha256, lines, case when status is null then 'new' when status = 'failed' then 'retry' else 'skip' end as action from scan left join old on old.sha256 = scan.sha256""",
)
def dry_run_actions(spark: SparkSession, d: str) -> DataFrame:
    scanned = table(spark, d, "ingest_log").where("sha is not null").select("ts", F.col("sha").alias("sha256"), "op").distinct().groupBy("sha256").agg(F.count("*").alias("lines"))
    return S.actions(scanned, documents(spark, d, "id, sha256, status, ingested_at").where("ingested_at < '2024-01-01'"))


@query("ingest_outcomes", "select op, status, count(*) as n from (select distinct * from ingest_log) group by op, status")
def ingest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ingest_log").distinct().groupBy("op", "status").agg(F.count("*").alias("n"))


@query(
    "insert_absent",
    f"""with {DOCS}, old as (select * from docs where ingested_at < '2024-01-01'), fresh as (select * from docs where sha256 not in (select sha256 from old)), hw as (select max(id) as m from old)
    select sha256, id from old union all select sha256, m + row_number() over (order by sha256) from fresh, hw""",
)
def insert_absent(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d, "id, sha256, ingested_at")
    old = docs.where("ingested_at < '2024-01-01'")
    mark = old.agg(F.max("id")).head()[0] or 0
    fresh = S.with_ids(S.new_rows(old, docs.drop("id")), mark, "sha256")
    return old.select("sha256", "id").unionByName(fresh.select("sha256", "id"))


@query(
    "upsert_replace",
    f"with {DOCS} select id, sha256, ingested_at, case when status = 'failed' then 'ok' else status end as status, case when status = 'failed' then 'again: ' || coalesce(title, contract_name, '') else title end as title from docs",
)
def upsert_replace(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d, "id, sha256, ingested_at, status, title, contract_name")
    updates = docs.where("status = 'failed'").select("id", F.lit("ok").alias("status"), F.concat(F.lit("again: "), F.coalesce("title", "contract_name", F.lit(""))).alias("title"))
    return S.upsert(docs.drop("contract_name"), updates, "id", keep=("sha256", "ingested_at"))


@query(
    "cascade_delete",
    f"""with {DOCS}, gone as (select id from docs where status = 'failed') select 'documents' as name, count(*) as n from docs where id not in (select id from gone)
    union all select 'obligations', count(*) from obl where doc_id not in (select id from gone) union all select 'document_seals', count(*) from seal where doc_id not in (select id from gone)""",
)
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d, "id, status")
    left = S.delete_cascade({"documents": docs, "obligations": obligations(spark, d), "document_seals": seals(spark, d)}, docs.where("status = 'failed'"))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "replace_children",
    f"with {DOCS}, up as (select id from docs where status = 'partial') select id, doc_id, action from obl where doc_id not in (select id from up) union all select id, doc_id, upper(action) from obl where doc_id in (select id from up)",
)
def replace_children(spark: SparkSession, d: str) -> DataFrame:
    obl = obligations(spark, d).select("id", "doc_id", "action")
    ids = documents(spark, d, "id, status").where("status = 'partial'").select(F.col("id").alias("doc_id"))
    return S.replace_children(obl, obl.join(ids, "doc_id", "left_semi").withColumn("action", F.upper("action")), ids)


@query(
    "subjects_distinct",
    f"""with {DOCS}, s as (select id, 0 as k, trim(party_a, e' \\t\\n　') as x from docs union all select id, 1, trim(party_b, e' \\t\\n　') from docs), f as (select id, x, min(k) as k from s where x <> '' group by id, x)
    select id as doc_id, (row_number() over (partition by id order by k) - 1)::int as ordering, x as subject from f""",
)
def subjects_distinct(spark: SparkSession, d: str) -> DataFrame:
    from sheaf.functions.normalise import ustrip

    names = F.array_distinct(F.filter(F.transform(F.array("party_a", "party_b"), ustrip), lambda x: x != ""))
    return documents(spark, d, "id, party_a, party_b").select(F.col("id").alias("doc_id"), F.posexplode(names).alias("ordering", "subject"))


@query("backfill", f"with {DOCS} select id, coalesce(title, contract_name) as title, coalesce(primary_date, sign_date) as primary_date, coalesce(primary_amount_cents, amount_cents) as primary_amount_cents from docs")
def backfill(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d, "id, title, contract_name, primary_date, sign_date, primary_amount_cents, amount_cents")
    return docs.select("id", *(F.coalesce(a, b).alias(a) for a, b in (("title", "contract_name"), ("primary_date", "sign_date"), ("primary_amount_cents", "amount_cents"))))


@query(
    "failed_commit",
    """with t as (select distinct id, status, output_dir from archive_documents) select id, 'failed' as status, case when status in ('ok', 'partial') and output_dir is not null then output_dir else 'documents/new' end as output_dir from t""",
)
def failed_commit(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "archive_documents").select("id", "status", "output_dir").distinct().withColumn("new_dir", F.lit("documents/new"))
    return docs.select("id", F.lit("failed").alias("status"), S.failed_outcome("status", "output_dir", "new_dir").alias("output_dir"))


@query(
    "ingest_status",
    """with t as (select distinct id, mineru_duration_s, llm_duration_s, error_message, title, summary, details_json from archive_documents)
    select id, case when error_message is not null and mineru_duration_s is null then 'failed' when error_message is not null or (coalesce(title, '') = '' and coalesce(summary, '') = '') then 'partial' else 'ok' end as status from t""",
)
def ingest_status(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "archive_documents").select("id", "mineru_duration_s", "llm_duration_s", "error_message", "title", "summary", "details_json").distinct()
    empty = (F.coalesce("title", F.lit("")) == "") & (F.coalesce("summary", F.lit("")) == "")
    bad = F.col("error_message").isNotNull()
    return t.select("id", F.when(bad & F.col("mineru_duration_s").isNull(), "failed").when(bad | empty, "partial").otherwise("ok").alias("status"))


QUALITY = r"""chars, non_ws, printable, cjk from (select {0}, length(t) as chars, length(regexp_replace(t, '[\s　\x{{a0}}\x{{85}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}]', '', 'g')) as non_ws,
    length(t) - length(regexp_replace(t, '[\x{{21}}-\x{{7e}}\x{{4e00}}-\x{{9fff}}]', '', 'g')) as printable, length(t) - length(regexp_replace(t, '[\x{{4e00}}-\x{{9fff}}]', '', 'g')) as cjk from {1})"""


@query("text_quality", "select doc_id, " + QUALITY.format("doc_id", "(select doc_id, coalesce(text, '') as t from documents)"))
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    return P.text_quality(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chars", "non_ws", "printable", "cjk")


@query("text_routes")
def text_routes(spark: SparkSession, d: str) -> DataFrame:
    return P.route(P.text_quality(table(spark, d, "documents").select("doc_id", "text"))).select("doc_id", "control", "replacement", "mode", "reason")


PAGE = "page as (select distinct doc_id, f, t from (select doc_id, 'raw_text' as f, coalesce(raw_text, '') as t from pipeline_outputs union all select doc_id, 'markdown', coalesce(markdown, '') from pipeline_outputs))"


def rendered(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pipeline_outputs")
    both = [p.select("doc_id", F.lit(c).alias("f"), F.coalesce(c, F.lit("")).alias("text")) for c in ("raw_text", "markdown")]
    return both[0].unionByName(both[1]).distinct()


@query(
    "routing_summary",
    f"with {PAGE}, q as (select doc_id, " + QUALITY.format("doc_id", "page") + "), r as (select doc_id, non_ws >= 50 and (printable / nullif(non_ws, 0) >= 0.85 or cjk / nullif(non_ws, 0) >= 0.12) as ok from q) select doc_id, count(*) as total, count(*) filter (ok) as text_pages, count(*) filter (not ok) as ocr_pages, 0::bigint as table_pages from r group by doc_id",
)
def routing_summary(spark: SparkSession, d: str) -> DataFrame:
    return P.routing_summary(P.route(P.text_quality(rendered(spark, d))), "doc_id")


@query("page_routing_totals", "select doc_id, coalesce(list_sum(map_values(page_routing)), 0)::bigint as pages, coalesce(element_at(page_routing, 'ocr_pages')[1], 0)::bigint as ocr_pages from (select distinct doc_id, page_routing from pipeline_outputs)")
def page_routing_totals(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pipeline_outputs").select("doc_id", F.array_sort(F.map_entries("page_routing")).alias("e")).distinct()
    total = F.aggregate("e", F.lit(0).cast("bigint"), lambda a, x: a + x["value"])
    ocr = F.aggregate(F.filter("e", lambda x: x["key"] == "ocr_pages"), F.lit(0).cast("bigint"), lambda a, x: a + x["value"])
    return p.select("doc_id", total.alias("pages"), ocr.alias("ocr_pages"))


@query(
    "section_split",
    rf"""with m as (select distinct doc_id, markdown from pipeline_outputs where markdown is not null), l as (select doc_id, unnest(string_split(markdown, chr(10))) as line, generate_subscripts(string_split(markdown, chr(10)), 1) as pos from m),
    h as (select *, regexp_matches(line, '^#{{1,6}}\s+.+$') as is_head from l), s as (select *, sum(is_head::int) over (partition by doc_id order by pos) as section from h)
    select doc_id, section::bigint as section, length(regexp_extract(max(line) filter (is_head), '^(#+)', 1))::int as level, trim(regexp_extract(max(line) filter (is_head), '^#+\s+(.+)$', 1), ' 　') as title,
    regexp_replace(coalesce(string_agg(line, chr(10) order by pos) filter (not is_head), ''), '^[\s　]+|[\s　]+$', '', 'g') as body from s where section > 0 group by doc_id, section""",
)
def section_split(spark: SparkSession, d: str) -> DataFrame:
    return P.sections(table(spark, d, "pipeline_outputs").select("doc_id", "markdown").where("markdown is not null").distinct(), "doc_id", "markdown")


@query(
    "guess_title",
    "select doc_id, list_extract(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, e' #\\t')), lambda x: length(x) between 4 and 80), 1) as title from documents",
)
def guess_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", P.guess_title("text").alias("title"))


BLOCKS = rf"""blk as (select doc_id, generate_subscripts(string_split(markdown, chr(10) || chr(10)), 1) - 1 as block_pos, regexp_replace(unnest(string_split(markdown, chr(10) || chr(10))), '[\s　]+', '', 'g') as t from (select distinct doc_id, markdown from pipeline_outputs where markdown is not null))"""


def blocks(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pipeline_outputs").where("markdown is not null").select("doc_id", "markdown").distinct()
    return p.select("doc_id", F.posexplode(F.split("markdown", "\n\n")).alias("block_pos", "text")).withColumn("page", F.col("block_pos"))


@query(
    "evidence_page_lookup",
    rf"""with {BLOCKS}, fr as (select distinct id as frag_id, doc_id, regexp_replace(evidence, '[\s　]+', '', 'g') as f from obligations where evidence is not null),
    w as (select frag_id, doc_id, i - 1 as win_pos, substr(f, i, 12) as sub from (select *, unnest(range(1, greatest(1, length(f) - 7) + 1)) as i from fr where length(f) >= 8)),
    h as (select w.doc_id, frag_id, min(struct_pack(a := win_pos, b := block_pos)) as m from w join blk on blk.doc_id = w.doc_id and contains(blk.t, w.sub) group by w.doc_id, frag_id)
    select doc_id, frag_id, m.b::int as page from h""",
)
def evidence_page_lookup(spark: SparkSession, d: str) -> DataFrame:
    frags = table(spark, d, "obligations").where("evidence is not null").select(F.col("id").alias("frag_id"), "doc_id", F.col("evidence").alias("fragment")).distinct()
    return P.find_pages(frags, blocks(spark, d), "doc_id")


@query("signature_pages", f"with {BLOCKS} select doc_id, array_to_string(list_slice(list_sort(list(block_pos)), 1, 4), ',') as pages from blk where regexp_matches(t, '签章|委托代理人|经办人') group by doc_id")
def signature_pages(spark: SparkSession, d: str) -> DataFrame:
    return P.signature_pages(blocks(spark, d), "doc_id").select("doc_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query(
    "page_selection",
    f"""with {BLOCKS}, p as (select doc_id, block_pos as page, contains(t, '附件') as has_tables, case when length(t) < 60 then 'ocr' else 'text' end as mode from blk),
    r as (select doc_id, page, case when page = 0 then 0 when has_tables then 1 when mode = 'ocr' then 2 end as rank from p), n as (select *, row_number() over (partition by doc_id order by rank, page) as n from r where rank is not null)
    select doc_id, page::int as page, rank, n::int as n from n where n <= 20""",
)
def page_selection(spark: SparkSession, d: str) -> DataFrame:
    t = F.regexp_replace("text", r"(?U)\s+", "")
    pages = blocks(spark, d).select("doc_id", "page", t.contains("附件").alias("has_tables"), F.when(F.length(t) < 60, "ocr").otherwise("text").alias("mode"))
    # At most 20 pages, the operator's default.
    return P.select_pages(pages, "doc_id")


@query(
    "bbox_scale",
    """with it(doc_id, page, pos, type, text_level, bbox) as (values (1, 0, 0, 'text', 1, [0, 0, 1000, 500]), (1, 1, 1, 'table', null, [100, 200, 300, 400]), (1, 2, 2, 'text', null, [1, 2, 3]), (1, 2, 3, 'unknown', null, [10, 20, 30, 40])),
    dim(doc_id, page, width, height) as (values (1, 0, 600.0, 800.0), (1, 1, 500.0, 1000.0)), b as (select it.*, coalesce(width, 595.0)::double as w, coalesce(height, 841.0)::double as h from it left join dim using (doc_id, page) where len(bbox) = 4)
    select doc_id, page, pos, case when type = 'text' and coalesce(text_level, 0) >= 1 then 'title' when type = 'text' then 'paragraph' when type = 'table' then 'table' else 'other' end as block_type, bbox[1] * w / 1000.0 as x0, bbox[2] * h / 1000.0 as y0, bbox[3] * w / 1000.0 as x1, bbox[4] * h / 1000.0 as y1 from b""",
)
def bbox_scale(spark: SparkSession, d: str) -> DataFrame:
    items = spark.createDataFrame([(1, 0, 0, "text", 1, [0, 0, 1000, 500]), (1, 1, 1, "table", None, [100, 200, 300, 400]), (1, 2, 2, "text", None, [1, 2, 3]), (1, 2, 3, "unknown", None, [10, 20, 30, 40])], "doc_id int, page int, pos int, type string, text_level int, bbox array<int>")
    dims = spark.createDataFrame([(1, 0, 600.0, 800.0), (1, 1, 500.0, 1000.0)], "doc_id int, page int, width double, height double")
    return P.scale_boxes(items, dims, "doc_id")
