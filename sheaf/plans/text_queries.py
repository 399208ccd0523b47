"""Queries of the vectorised text functions and of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.api import capabilities as catalogue
from sheaf.functions import text as T
from sheaf.operators.pages import correct_pages
from sheaf.plans.page_queries import blocks
from sheaf.plans.registry import query
from sheaf.sources.tables import table


@query("compare_form")
def compare_form(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "archive_documents").select("id", "title").distinct().select("id", T.compare_form("title").alias("form"))


@query("text_similarity")
def text_similarity(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "archive_documents").select("id", "title", "contract_name").distinct()
    return t.select("id", F.round(T.text_similarity(T.compare_form("title"), T.compare_form("contract_name")), 9).alias("similarity"))


@query("highlight_terms")
def highlight_terms(spark: SparkSession, d: str) -> DataFrame:
    """Each rendering with its document's parties and amounts marked."""
    a = table(spark, d, "archive_documents")
    terms = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("term"), F.lit(k).alias("category"))) for c, k in (("party_a", "party"), ("party_b", "party"), ("amount_text", "amount"), ("sign_date", "date")))))
    docs = a.select("id", "party_a", "party_b", "amount_text", "sign_date").distinct().select(F.col("id").alias("doc_id"), terms.alias("terms"))
    pages = table(spark, d, "pipeline_outputs").select("doc_id", "raw_text").distinct()
    return pages.join(docs, "doc_id").select("doc_id", T.highlight("raw_text", "terms").alias("marked"))


@query("correct_evidence_pages")
def correct_evidence_pages(spark: SparkSession, d: str) -> DataFrame:
    issues = table(spark, d, "completeness_issues").select("id", "doc_id", "evidence").distinct()
    return correct_pages(issues, blocks(spark, d), "doc_id", "id", "evidence").select("id", "evidence")


@query("capabilities")
def capabilities(spark: SparkSession, d: str) -> DataFrame:
    return catalogue(spark)
