"""Measures of model runs, displays of records and small completions of a document's issues, as column and frame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.normalise import col, evidence_page, issue_item, issue_side, short_message, ustrip
from sheaf.functions.text import text_similarity


def costs(runs: DataFrame, prices: DataFrame, default: tuple[float, float]) -> DataFrame:
    """``runs`` (model, input_tokens, output_tokens) with ``cost`` by a price per million tokens (model, price_in, price_out).

    A model without a price has the default's; a run without any count has no cost.  The price list is one row a model."""
    known = prices.groupBy("model").agg(F.max("price_in").alias("price_in"), F.max("price_out").alias("price_out"))
    both = runs.join(known, "model", "left")
    part = lambda n, p, d: F.coalesce(n, F.lit(0)) / F.lit(1e6) * F.coalesce(p, F.lit(d))
    cost = part("input_tokens", "price_in", default[0]) + part("output_tokens", "price_out", default[1])
    return both.withColumn("cost", F.when(F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull(), cost)).drop("price_in", "price_out")


def run_measures(firsts: DataFrame, model: str = "model") -> DataFrame:
    """Of each model's first runs (parse_ok, cost, sig_tp, sig_fn): parse rate, cost of 1,000 documents over runs that have
    one, and signature recall pooled over cases, null without any signature."""
    found, missed = F.coalesce(F.sum("sig_tp"), F.lit(0)), F.coalesce(F.sum("sig_fn"), F.lit(0))
    return firsts.groupBy(model).agg(
        F.avg(F.coalesce("parse_ok", F.lit(False)).cast("int")).alias("parse_rate"), (F.avg("cost") * 1000).alias("cost_per_1k"), F.when(found + missed > 0, found / (found + missed)).alias("sig_recall"),
    )


def determinism(runs: DataFrame, model: str, case: str, value: str) -> DataFrame:
    """Whether all runs of a case gave the same value (null is a value of its own), for cases run more than once."""
    by = runs.groupBy(model, case).agg(F.count("*").alias("n"), F.count_distinct(value).alias("k"), F.max(F.col(value).isNull()).alias("none"))
    return by.where("n > 1").select(model, case, ((F.col("k") + F.col("none").cast("int")) == 1).alias("same"))


def champion_first(rows: DataFrame, model: str, line: str, champion: str) -> DataFrame:
    """Each model with its place in the report: the champion first, the others as they were first seen."""
    firsts = rows.groupBy(model).agg(F.min(line).alias("_line"))
    order = F.struct((F.col(model) != champion).alias("other"), F.col("_line").alias("line"), F.col(model).alias("model"))
    ranked = firsts.agg(F.array_sort(F.collect_list(order)).alias("all")).select(F.posexplode("all").alias("place", "m"))  # one row a model
    return ranked.select(F.col("m.model").alias(model), "place")


def amount_display(total: Column | str, primary: Column | str) -> Column:
    """The computed total, marked with a star, else the primary amount, in whole yuan; '-' for neither."""
    yuan = lambda c: F.concat(F.lit("¥"), F.format_number(F.bround(col(c), 0), 0))
    return F.when(col(total).isNotNull(), F.concat(yuan(total), F.lit("*"))).when(col(primary).isNotNull(), yuan(primary)).otherwise("-")


def period_label(start: Column | str, end: Column | str) -> Column:
    """' [start~end]' with ? for a missing side; '' for none of both."""
    side = lambda c: F.coalesce(F.nullif(col(c), F.lit("")), F.lit("?"))
    none = (F.coalesce(col(start), F.lit("")) == "") & (F.coalesce(col(end), F.lit("")) == "")
    return F.when(none, "").otherwise(F.concat(F.lit(" ["), side(start), F.lit("~"), side(end), F.lit("]")))


def unescape_markdown(text: Column | str) -> Column:
    """Backslashes before markdown signs off; every run of underscores, the blanks of forms, one space."""
    return F.regexp_replace(F.regexp_replace(col(text), r"\\([-_*\[\]()#+.!`])", "$1"), "_+", " ")


def document_text(raw: Column | str, markdown: Column | str) -> Column:
    """The raw text where there is one, else the markdown, else ''."""
    return F.coalesce(col(raw), col(markdown), F.lit(""))


def legend(categories: Column, order: list[str]) -> Column:
    """The categories in use, in their fixed order."""
    return F.array_join(F.array_intersect(F.array(*map(F.lit, order)), categories), "  ")


def page_list(pages: Column) -> Column:
    """'据落款页图：第 a、b 页' of an array of page numbers."""
    return F.concat(F.lit("据落款页图：第 "), F.array_join(pages.cast("array<string>"), "、"), F.lit(" 页"))


def candidate_lines(candidates: DataFrame, *keys: str) -> DataFrame:
    """Candidates (pos, source, page, value, evidence) of each field as a list of lines."""
    place = F.when(F.col("page").isNotNull(), F.concat(F.lit("（第"), F.col("page"), F.lit("页）"))).otherwise("")
    proof = F.when(F.coalesce("evidence", F.lit("")) != "", F.concat(F.lit(" 证据："), "evidence")).otherwise("")
    line = F.concat(F.lit("- ["), "source", place, F.lit("] "), F.coalesce("value", F.lit("")), proof)
    rows = candidates.select(*keys, "pos", line.alias("line"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("lines"))


def rejudged(issues: DataFrame, seals: DataFrame, key: str) -> DataFrame:
    """Issues (key, item, category, evidence) after the seals were looked at: the signature issues of documents in ``seals``
    (key, checked, and an issue or null) are replaced by those found there, the others kept."""
    looked = seals.select(key).distinct()
    kept = issues.where("category <> 'signature' or category is null").unionByName(issues.where("category = 'signature'").join(looked, key, "left_anti"))
    return kept.unionByName(seals.where("item is not null").select(key, "item", "category", "evidence"))


def status_after(documents: DataFrame, issues: DataFrame, key: str, status: str) -> DataFrame:
    """Status of each document once its issues are counted: incomplete with any issue, else as it was."""
    counted = issues.groupBy(key).agg(F.count("*").alias("n_issues"))
    both = documents.join(counted, key, "left")
    return both.select(key, F.when(F.coalesce("n_issues", F.lit(0)) > 0, "incomplete").otherwise(F.col(status)).alias("status"), F.coalesce("n_issues", F.lit(0)).alias("n_issues"))


def gated_confidence(documents: DataFrame, overall: DataFrame, key: str, threshold: float = 0.6) -> DataFrame:
    """Documents (key, doc_type, confidence) with the fusion's confidence in place of their own, for policies only, and
    whether it asks for escalation."""
    both = documents.join(overall.select(key, "overall"), key, "left")
    fused = (F.col("doc_type") == "保险凭证") & F.col("overall").isNotNull()
    return both.select(key, F.when(fused, F.col("overall")).otherwise(F.col("confidence")).alias("confidence"), (fused & (F.col("overall") < threshold)).alias("escalate"))


def issue_likeness(g: dict[str, str], p: dict[str, str]) -> Column:
    """How well an issue meets another (columns item, category, evidence of each): 0 for other categories, parties or pages
    more than one apart, else 1 on the same page, 0.7 on the next, 0.6 where a page is unknown, if the items are alike."""
    a, b = evidence_page(g["evidence"]), evidence_page(p["evidence"])
    page = F.when(a.isNull() | b.isNull(), 0.6).when(a == b, 1.0).when(F.abs(a - b) <= 1, 0.7).otherwise(0.0)
    x, y = issue_item(g["item"]), issue_item(p["item"])
    mine, other = issue_side(x), issue_side(y)
    fits = (F.col(g["category"]) == F.col(p["category"])) & ((mine == "") | (other == "") | (mine == other)) & (text_similarity(x, y) >= 0.6)
    return F.when(fits, page).otherwise(0.0)


def verdict_scores(gold: DataFrame, pred: DataFrame, case: str) -> DataFrame:
    """tp, fp, fn of each case's verdicts (case, key, norm): equal key and value; a case without gold is neutral.

    Repeats of a verdict meet one for one, so they are counted, not listed."""
    g = gold.groupBy(case, "key", "norm").agg(F.count("*").alias("g"))
    p = pred.groupBy(case, "key", "norm").agg(F.count("*").alias("p"))
    both = g.join(p, (g[case] == p[case]) & (g["key"] == p["key"]) & g["norm"].eqNullSafe(p["norm"]) & (g["key"] != ""), "left").select(g[case], "g", F.least("g", F.coalesce("p", F.lit(0))).alias("hit"))
    hits = both.groupBy(case).agg(F.sum("g").alias("gold"), F.sum("hit").alias("tp"))
    n = pred.groupBy(case).agg(F.count("*").alias("pred"))
    return hits.join(n, case, "left").select(case, "tp", (F.coalesce("pred", F.lit(0)) - F.col("tp")).alias("fp"), (F.col("gold") - F.col("tp")).alias("fn"))


def retry_after(header: Column | str) -> Column:
    """Seconds of a Retry-After header given as a number; null for anything else."""
    return ustrip(col(header)).try_cast("double")


# Codes and categories of failures that no exception stands for.
FAILURES = {"config": ("CONFIG_MISSING", "config"), "extract": ("EXTRACT_EMPTY", "validation"), "parse": ("MINERU_FAILED", "infra")}


def failure(kind: Column | str, detail: Column | str) -> Column:
    """{code, category, message, retryable} of a failure; none of them is worth a retry."""
    pick = lambda k: F.try_element_at(F.create_map(*(F.lit(x) for a, b in FAILURES.items() for x in (a, b[k]))), col(kind))
    return F.struct(pick(0).alias("code"), pick(1).alias("category"), short_message(detail).alias("message"), F.lit(False).alias("retryable"))
