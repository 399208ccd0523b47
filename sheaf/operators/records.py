"""Raw extraction answers to typed records, and the checks on them: coercion, totals, consistency, fees, identity filter.

Answers are read as VARIANT, so misshapen members never fail a row: what is not a list is empty, what is not an
object in a list is skipped.  Positions are those in the raw list, before skipping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import normalise as N

DOC_TYPES = ("合同协议", "保险凭证", "证明", "发票票据", "报告", "旅行资料", "证件", "其他")


def answer(c: str) -> Column:
    """The variant of a JSON text; null if it is unreadable."""
    return F.try_parse_json(c)


def member(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def text_of(v: Column, path: str) -> Column:
    """A member as stripped text, '' for none."""
    return F.coalesce(N.ustrip(member(v, path)), F.lit(""))


def exploded(df: DataFrame, v: str, path: str, *keep: str) -> DataFrame:
    """One row (keep, pos, x) for each object in a list; other elements are skipped but counted."""
    rows = df.select(*keep, F.posexplode(member(F.col(v), path, "array<variant>")).alias("pos", "x"))
    return rows.where(F.schema_of_variant("x").startswith("OBJECT"))


def envelope_amounts(df: DataFrame, v: str, *keep: str) -> DataFrame:
    """Amounts with their value; unit prices and instalments never count towards the total."""
    x = F.col("x")
    text = F.when(text_of(x, "$.text") != "", text_of(x, "$.text")).otherwise(text_of(x, "$.value"))
    unit = F.nullif(text_of(x, "$.unit"), F.lit(""))
    part = F.coalesce(member(x, "$.is_installment", "boolean"), F.lit(False))
    total = F.coalesce(member(x, "$.is_total_component", "boolean"), F.lit(False))
    rows = exploded(df, v, "$.amounts", *keep).select(*keep, "pos", F.coalesce(F.nullif(text_of(x, "$.label"), F.lit("")), F.lit("金额")).alias("label"), text.alias("text"), unit.alias("unit"), part.alias("is_installment"), total.alias("_t"))
    rows = rows.where("text <> ''").withColumn("value", N.money("text"))
    return rows.withColumn("is_total_component", F.col("_t") & F.col("unit").isNull() & ~F.col("is_installment")).drop("_t")


def envelope_dates(df: DataFrame, v: str, *keep: str) -> DataFrame:
    x = F.col("x")
    rows = exploded(df, v, "$.key_dates", *keep).select(*keep, "pos", text_of(x, "$.label").alias("l"), F.nullif(text_of(x, "$.date"), F.lit("")).alias("d"))
    return rows.where("l <> '' or d is not null").select(*keep, "pos", F.when(F.col("l") == "", "日期").otherwise(F.col("l")).alias("label"), N.norm_date("d").alias("date"))


def envelope_obligations(df: DataFrame, v: str, *keep: str) -> DataFrame:
    """Obligations with a known actor and an action; deadlines as ISO dates."""
    x = F.col("x")
    actor = text_of(x, "$.actor")
    actor = F.when(actor.isin("甲方", "Party A", "partyA"), "party_a").when(actor.isin("乙方", "Party B", "partyB"), "party_b").when(actor.isin("双方", "Both"), "both").otherwise(actor)
    rows = exploded(df, v, "$.obligations", *keep).select(*keep, F.col("pos").alias("ordering"), actor.alias("actor"), F.substring(text_of(x, "$.action"), 1, 200).alias("action"), N.norm_date(member(x, "$.deadline")).alias("deadline"), F.substring(text_of(x, "$.evidence"), 1, 500).alias("evidence"))
    return rows.where("actor in ('party_a', 'party_b', 'both') and action <> ''")


def envelope_seals(df: DataFrame, v: str, *keep: str) -> DataFrame:
    """Seals of the main agreement, then those of the sub-agreements, in order; blank ones are skipped but counted."""
    own = F.coalesce(member(F.col(v), "$.seals", "array<variant>"), F.array().cast("array<variant>"))
    subs = F.coalesce(member(F.col(v), "$.sub_agreements", "array<variant>"), F.array().cast("array<variant>"))
    more = F.flatten(F.transform(subs, lambda s: F.coalesce(member(s, "$.seals", "array<variant>"), F.array().cast("array<variant>"))))
    rows = df.select(*keep, F.posexplode(F.filter(F.concat(own, more), lambda x: F.schema_of_variant(x).startswith("OBJECT"))).alias("ordering", "x"))
    x = F.col("x")
    rows = rows.select(*keep, "ordering", F.nullif(text_of(x, "$.owner"), F.lit("")).alias("owner"), F.nullif(text_of(x, "$.seal_type"), F.lit("")).alias("seal_type"), text_of(x, "$.raw_text").alias("raw_text"))
    return rows.where("raw_text <> '' or owner is not null")


def envelope_identities(df: DataFrame, v: str, *keep: str) -> DataFrame:
    """One row for each identifier of each person or organisation, with both positions."""
    x, y = F.col("x"), F.col("y")
    people = exploded(df, v, "$.person_identities", *keep).select(*keep, "pos", text_of(x, "$.name").alias("name"), F.nullif(text_of(x, "$.role"), F.lit("")).alias("role"), F.posexplode(member(x, "$.identifiers", "array<variant>")).alias("ipos", "y"))
    rows = people.where(F.schema_of_variant("y").startswith("OBJECT")).select(*keep, "pos", "name", "role", "ipos", text_of(y, "$.label").alias("label"), text_of(y, "$.value").alias("value"))
    return rows.where("name <> '' and label <> '' and value <> ''")


def envelope_completeness(df: DataFrame, v: str, *keep: str) -> DataFrame:
    """Status and issue count of agreements only: a bad status is unknown, a complete one with issues incomplete."""
    c = F.col(v)
    kind = text_of(c, "$.doc_type")
    issues = F.filter(F.coalesce(member(c, "$.completeness.issues", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    named = F.size(F.filter(issues, lambda x: text_of(x, "$.item") != ""))
    status = text_of(c, "$.completeness.status")
    status = F.when(status.isin("complete", "incomplete", "unknown"), status).otherwise("unknown")
    status = F.when((named > 0) & (status == "complete"), "incomplete").otherwise(status)
    there = F.schema_of_variant(member(c, "$.completeness", "variant")).startswith("OBJECT") & (kind == "合同协议")
    return df.select(*keep, F.when(F.coalesce(there, F.lit(False)), status).alias("status"), F.when(F.coalesce(there, F.lit(False)), named).alias("n_issues"))


def doc_type(v: Column) -> Column:
    kind = text_of(v, "$.doc_type")
    return F.when(kind.isin(*DOC_TYPES), kind).otherwise("其他")


def computed_totals(amounts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sum of the parts of the total of each document, rounded to cents; no row without parts."""
    counted = amounts.where("is_total_component and unit is null and not is_installment and value is not null")
    return counted.groupBy(key).agg(F.bround(F.sum(F.col("value").cast("decimal(24,6)")), 2).cast("double").alias("total"))


def tolerance(total: Column) -> Column:
    """Of comparisons with a total: 1 or 1 %, the larger."""
    return F.greatest(F.lit(1.0), F.abs(total) * 0.01)


def overshooting_instalments(amounts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose instalments exceed the total by more than the tolerance."""
    parts = amounts.where("is_installment and value is not null").groupBy(key).agg(F.bround(F.sum("value"), 2).alias("instalments"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordering", "id", "label"))), lambda x: x["label"]), "＋").alias("labels"))
    both = parts.join(computed_totals(amounts, key), key).where("total > 0")
    return both.withColumn("over", F.bround(F.col("instalments") - F.col("total"), 2)).where(F.col("over") > tolerance(F.col("total")))


def overshooting_items(amounts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Single amounts outside total and instalments that exceed the total."""
    loose = amounts.where("not is_total_component and not is_installment and unit is null and value is not null")
    both = loose.join(computed_totals(amounts, key), key).where("total > 0")
    return both.where(F.col("value") > F.col("total") + tolerance(F.col("total")))


def is_area_month(unit: Column | str) -> Column:
    u = N.col(unit)
    return u.rlike("㎡|平方米|平米|m²") & u.contains("月")


def building_area(fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """Building area of each document from its labelled fields: a predicted or plain one first, else the first; inner and shared ones don't count."""
    usable = fields.where(F.col("label").contains("建筑面积") & ~F.col("label").rlike("套内|分摊|共有")).withColumn("area", F.regexp_extract("value", r"(\d+(?:\.\d+)?)", 1).try_cast("double")).where("area is not null")
    best = F.struct((~(F.col("label").contains("预测") | (N.ustrip("label") == "建筑面积"))).alias("second"), "pos", "area")
    return usable.groupBy(key).agg(F.min(best).alias("b")).select(key, F.col("b.area").alias("area"))


def monthly_fees(amounts: DataFrame, areas: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sum of prices per square metre and month (4 places) times the area (2 places)."""
    prices = amounts.where("value is not null").where(is_area_month("unit")).groupBy(key).agg(F.bround(F.sum("value"), 4).alias("price"))
    return prices.join(areas.where("area > 0"), key).withColumn("fee", F.bround(F.col("price") * F.col("area"), 2))


def names_in_text(identities: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Identities whose name, without white space, stands in their document's text; all are kept where the text is empty."""
    both = identities.join(texts.select(key, N.ws_free("text").alias("_text")), key, "left")
    return both.where(F.coalesce(F.col("_text"), F.lit("")) == "").unionByName(both.where((F.col("_text") != "") & F.contains("_text", N.ws_free("name")))).drop("_text")


def envelope_confidence(title: Column, summary: Column, *others: Column) -> Column:
    """0 without title and summary, else half and a tenth for each filled member, at most 0.9."""
    filled = lambda c: F.coalesce(N.ustrip(c.cast("string")), F.lit("")) != ""
    points = sum((F.when(filled(c), 1).otherwise(0) for c in others), F.lit(0))
    return F.when(~filled(title) & ~filled(summary), 0.0).otherwise(F.least(F.lit(0.9), F.round(0.5 + 0.1 * points, 1)))


def share_filled(weight: float, *columns: Column) -> Column:
    """Mean over columns of the weight where one is filled and 0 where not."""
    filled = lambda c: F.when(F.coalesce(N.ustrip(c.cast("string")), F.lit("")) != "", weight).otherwise(0.0)
    return F.round(sum((filled(c) for c in columns), F.lit(0.0)) / len(columns), 6)


def usage_totals(df: DataFrame, v: str, *keys: str) -> DataFrame:
    """Token usage summed over answers; a side no answer gives stays null."""
    use = lambda n, m: F.coalesce(member(F.col(v), f"$.llm_usage.{n}", "bigint"), member(F.col(v), f"$.llm_usage.{m}", "bigint"))
    rows = df.select(*keys, use("input_tokens", "prompt_tokens").alias("i"), use("output_tokens", "completion_tokens").alias("o"))
    return rows.groupBy(*keys).agg(F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.count_if(F.col("i").isNotNull() | F.col("o").isNotNull()).alias("answers"))
