"""The relational archive: filtered search, boards, statistics, lookups and hydrated rows, as DataFrame plans.

Every function takes DataFrames of the parent table and its children and returns a lazy DataFrame; only predicates that
are set are part of the plan.  Dates are ISO text and compared as text.  A LIKE keyword may hold ``%`` and ``_`` and
is case-insensitive for ASCII letters only.  Orders end in the key, so results are the same at any partitioning.

Edge cases: null columns match no predicate but tri-state ones that ask for nothing; empty keywords ask for nothing;
empty tables give empty boards and zero statistics.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER_COLUMNS = ("ingested_at", "sign_date", "expire_date", "amount_cents", "primary_date", "primary_amount_cents")
ACTORS = ("party_a", "party_b", "both")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def ascii_like(c: Column | str, keyword: str) -> Column:
    """Substring match, ASCII case folded, wildcards of the keyword kept, backslash literal."""
    folded = keyword.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)).replace("\\", "\\\\")
    return ascii_lower(F.col(c) if isinstance(c, str) else c).like(f"%{folded}%")


@dataclass(frozen=True)
class SearchFilter:
    """What to search for; None and '' ask for nothing.  Amounts are cents, dates ISO text, all bounds inclusive."""

    name: str | None = None
    party: str | None = None
    amount_min: int | None = None
    amount_max: int | None = None
    signed_after: str | None = None
    signed_before: str | None = None
    expire_before: str | None = None
    auto_renewal: bool | None = None
    has_risk: bool = False
    obligation_before: str | None = None
    obligation_after: str | None = None
    obligation_actor: str | None = None
    has_seal: bool | None = None
    seal_owner: str | None = None
    seal_type: str | None = None
    subject: str | None = None
    doc_type: str | None = None
    status: str | None = None
    incomplete: bool = False
    limit: int = 50

    def parent(self) -> list[Column]:
        c = F.col
        out = []
        if self.name:
            out.append(ascii_like("contract_name", self.name))
        if self.party:
            out.append(ascii_like("party_a", self.party) | ascii_like("party_b", self.party))
        if self.amount_min is not None:
            out.append(c("amount_cents") >= self.amount_min)
        if self.amount_max is not None:
            out.append(c("amount_cents") <= self.amount_max)
        if self.signed_after:
            out.append(c("sign_date") >= self.signed_after)
        if self.signed_before:
            out.append(c("sign_date") <= self.signed_before)
        if self.expire_before:
            out.append(c("expire_date") <= self.expire_before)
        if self.auto_renewal is not None:
            out.append(c("auto_renewal") == int(self.auto_renewal))
        if self.doc_type:
            out.append(c("doc_type") == self.doc_type)
        if self.status:
            out.append(c("status") == self.status)
        if self.incomplete:
            out.append(c("completeness_status") == "incomplete")
        return out


def where_all(df: DataFrame, predicates: list[Column]) -> DataFrame:
    return df.where(reduce(and_, predicates)) if predicates else df


def check_actor(actor: str | None) -> None:
    if actor and actor not in ACTORS:
        raise ValueError(f"actor must be one of {ACTORS}")


def matching(documents: DataFrame, flt: SearchFilter, obligations: DataFrame | None = None, seals: DataFrame | None = None, subjects: DataFrame | None = None, risks: DataFrame | None = None) -> DataFrame:
    """The documents a filter asks for: parent predicates first, then at most one semi or anti join a child table.

    Predicates on one child must hold on the same row, so they are joined as one filtered set of keys."""
    check_actor(flt.obligation_actor)
    out = where_all(documents, flt.parent())
    if flt.has_risk:
        out = out.join(risks.select(F.col("doc_id").alias("id")), "id", "left_semi")
    wanted = [F.col("deadline") <= flt.obligation_before] * bool(flt.obligation_before) + [F.col("deadline") >= flt.obligation_after] * bool(flt.obligation_after)
    wanted += [F.col("actor") == flt.obligation_actor] * bool(flt.obligation_actor)
    if wanted:
        out = out.join(where_all(obligations, wanted).select(F.col("doc_id").alias("id")), "id", "left_semi")
    if flt.has_seal is not None:
        out = out.join(seals.select(F.col("doc_id").alias("id")), "id", "left_semi" if flt.has_seal else "left_anti")
    wanted = ([ascii_like("owner", flt.seal_owner)] if flt.seal_owner else []) + ([ascii_like("seal_type", flt.seal_type)] if flt.seal_type else [])
    if wanted:
        out = out.join(where_all(seals, wanted).select(F.col("doc_id").alias("id")), "id", "left_semi")
    if flt.subject:
        out = out.join(subjects.where(ascii_like("subject", flt.subject)).select(F.col("doc_id").alias("id")), "id", "left_semi")
    return out


def search(documents: DataFrame, flt: SearchFilter, **children: DataFrame) -> DataFrame:
    """The newest ``limit`` matches."""
    return matching(documents, flt, **children).orderBy(F.col("ingested_at").desc_nulls_last(), "id").limit(flt.limit)


def list_documents(documents: DataFrame, limit: int = 50, order_by: str = "ingested_at", status: str | None = None, doc_type: str | None = None, incomplete: bool = False) -> DataFrame:
    if order_by not in ORDER_COLUMNS:
        raise ValueError(f"order_by must be one of {ORDER_COLUMNS}")
    out = where_all(documents, SearchFilter(status=status, doc_type=doc_type, incomplete=incomplete).parent())
    return out.orderBy(F.col(order_by).desc_nulls_last(), "id").limit(limit)


def todo(obligations: DataFrame, documents: DataFrame, actor: str | None = None, before: str | None = None, after: str | None = None, include_undated: bool = False, limit: int | None = 50) -> DataFrame:
    """Obligations with their document, dated ones first by deadline."""
    check_actor(actor)
    bounds = [F.col("deadline") <= before] * bool(before) + [F.col("deadline") >= after] * bool(after)
    dated = where_all(obligations.where(F.col("deadline").isNotNull()), bounds)
    rows = dated.unionByName(obligations.where(F.col("deadline").isNull())) if include_undated else dated
    rows = rows.where(F.col("actor") == actor) if actor else rows
    doc = documents.select(F.col("id").alias("doc_id"), "contract_name", "title", "party_a", "party_b")
    out = rows.select(F.col("id").alias("obligation_id"), "doc_id", "actor", "action", "deadline", "ordering").join(doc, "doc_id")
    out = out.orderBy(F.col("deadline").isNull(), "deadline", "doc_id", "ordering", "obligation_id")
    return out.limit(limit) if limit else out


def seal_board(seals: DataFrame, documents: DataFrame, owner: str | None = None, seal_type: str | None = None, limit: int | None = 200) -> DataFrame:
    rows = where_all(seals, ([ascii_like("owner", owner)] if owner else []) + ([ascii_like("seal_type", seal_type)] if seal_type else []))
    doc = documents.select(F.col("id").alias("doc_id"), F.coalesce("title", "contract_name").alias("doc_title"))
    out = rows.select(F.col("id").alias("seal_id"), "doc_id", "owner", "seal_type", "raw_text", "ordering").join(doc, "doc_id")
    out = out.orderBy(F.col("owner").asc_nulls_last(), F.col("seal_type").asc_nulls_first(), "doc_id", "ordering", "seal_id")
    return out.limit(limit) if limit else out


def hydrate(documents: DataFrame, obligations: DataFrame, seals: DataFrame) -> DataFrame:
    """Documents with their children as ordered arrays; each child is aggregated before the join, childless ones get [].

    Exact copies of a child count once: the arrays are gathered as sets, so no shuffle is spent on dropping them first."""

    def gathered(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("ordering", "id", *columns))), lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias(name)).withColumnRenamed("doc_id", "id")

    o, s = gathered(obligations, "obligations", "actor", "action", "deadline"), gathered(seals, "seals", "owner", "seal_type")
    out = documents.join(o, "id", "left").join(s, "id", "left")
    return out.withColumns({n: F.coalesce(n, F.array().cast(out.schema[n].dataType)) for n in ("obligations", "seals")})


def resolve(documents: DataFrame, ident: str) -> DataFrame:
    """The document an identifier names: an id of at most 18 digits first, else a hash prefix of at least 4 characters that fits one."""
    by_id = documents.where(F.col("id") == int(ident)).withColumn("_rank", F.lit(0)) if ident.isdigit() and len(ident) <= 18 else None
    if len(ident) < 4 and by_id is None:
        return documents.limit(0)
    out = by_id
    if len(ident) >= 4:
        prefix = ident.lower()
        hits = documents.where(F.col("sha256").startswith(prefix))
        only = hits.agg(F.count("*").alias("_n"), F.first(F.struct(*documents.columns)).alias("_row")).where("_n = 1")
        by_sha = only.select("_row.*").withColumn("_rank", F.lit(1))
        out = by_sha if out is None else out.unionByName(by_sha)
    return out.orderBy("_rank").limit(1).drop("_rank")


def by_prefix(documents: DataFrame, prefix: str, least: int = 4) -> DataFrame:
    """All documents whose hash starts with a prefix of at least ``least`` characters, newest first."""
    if len(prefix) < least:
        raise ValueError(f"a hash prefix needs at least {least} characters")
    return documents.where(F.col("sha256").startswith(prefix.lower())).orderBy(F.col("ingested_at").desc_nulls_last(), "id")


def stats(documents: DataFrame, as_of: str) -> DataFrame:
    """Totals in one pass: all, this month's, expiring within 30 days of ``as_of``, and counts by status and month as maps."""
    day = F.lit(as_of).cast("date")
    end = F.date_format(F.date_add(day, 30), "yyyy-MM-dd")
    flat = documents.groupBy("status", F.substring("sign_date", 1, 7).alias("month")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("ingested_at").startswith(as_of[:7])).alias("new"),
        F.count_if((F.col("expire_date") >= as_of) & (F.col("expire_date") <= end)).alias("expiring"),
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("n", "total"), ("new", "new_this_month"), ("expiring", "expiring_within_30d"))]
    whole = flat.agg(*sums, F.collect_list(F.struct("status", "month", "n")).alias("_g"))  # one entry for each status and month

    def by(field: str) -> Column:
        keys = F.array_sort(F.array_distinct(F.filter(F.transform("_g", lambda x: x[field]), lambda k: k.isNotNull())))
        count = lambda k: F.aggregate(F.filter("_g", lambda x: x[field] == k), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, count(k))))

    return whole.select("total", "new_this_month", "expiring_within_30d", by("status").alias("by_status"), by("month").alias("by_sign_month"))


def subject_label(parties: Column, a: Column, b: Column) -> Column:
    """The first two parties, else party_a and party_b, joined by 、 and cut to 20 characters."""
    pair = F.filter(F.array(a, b), lambda x: x.isNotNull())
    text = F.array_join(F.slice(F.when(F.size(parties) > 0, parties).otherwise(pair), 1, 2), "、")
    return F.when(F.length(text) > 20, F.concat(F.substring(text, 1, 19), F.lit("…"))).otherwise(text)
