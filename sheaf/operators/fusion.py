"""Values of one field from several sources: agreement, verdicts, confidence; seals and signers against the parties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import normalise as N

# Confidence of verdicts.
AGREED, SINGLE, NO_IMAGE = 0.95, 0.7, 0.4
SOURCE_ORDER = {"text": 0, "vision": 1}
NULL_WORDS = ("", "null", "none", "n/a", "无", "未知")


def candidate_value(c: Column | str) -> Column:
    """A candidate's value, null for the words that mean none."""
    s = N.ustrip(N.col(c))
    return F.when(~F.lower(s).isin(*NULL_WORDS), s)


def agreement(candidates: DataFrame, *keys: str) -> DataFrame:
    """For each field: sources, different values (normalised) and whether all agree.  Partial aggregates first, no row groups."""
    ranked = candidates.withColumn("_o", F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in SOURCE_ORDER.items() for x in p)), F.col("source")), F.lit(9)))
    given = F.when(F.coalesce("value", F.lit("")) != "", F.col("value"))
    return ranked.groupBy(*keys).agg(
        F.count_distinct("source").alias("n_sources"),
        F.count_distinct(F.when(given.isNotNull(), N.fusion_value("value"))).alias("n_values"),
        F.min(F.when(given.isNotNull(), F.struct("_o", "pos", "value"))).alias("_first"),
        F.min(F.when(given.isNotNull() & (F.col("source") == "vision"), F.struct("pos", "value"))).alias("_vision"),
        F.min(F.struct("_o", "source")).alias("_src"),
    )


def verdicts(candidates: DataFrame, *keys: str, adjudicated: DataFrame | None = None, threshold: float = 0.6) -> DataFrame:
    """A verdict for each field: agreed values at once, disputed ones from ``adjudicated`` (keys, value, confidence,
    low_confidence) where it has them, else the vision value or the first, marked as uncertain."""
    a = agreement(candidates, *keys)
    same = F.col("n_values") == 1
    if adjudicated is not None:
        a = a.join(adjudicated.select(*keys, F.col("value").alias("_av"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)))).alias("_ac"), F.coalesce("low_confidence", F.lit(False)).alias("_al")), list(keys), "left")
    else:
        a = a.withColumns({"_av": F.lit(None).cast("string"), "_ac": F.lit(None).cast("double"), "_al": F.lit(None).cast("boolean")})
    first, vision = F.col("_first.value"), F.col("_vision.value")
    judged = F.col("_ac").isNotNull()
    return a.select(
        *keys,
        F.when(same, first).when(judged, F.col("_av")).otherwise(F.coalesce(vision, first)).alias("value"),
        F.when(same & (F.col("n_sources") > 1), "agreed").when(same, F.col("_src.source")).otherwise("adjudicated").alias("source"),
        F.when(same & (F.col("n_sources") > 1), AGREED).when(same, SINGLE).when(judged, F.col("_ac")).otherwise(NO_IMAGE).alias("confidence"),
        F.when(same, F.lit(False)).when(judged, F.col("_al") | (F.col("_ac") < threshold)).otherwise(True).alias("low_confidence"),
    )


def overall(verdict_rows: DataFrame, *keys: str) -> DataFrame:
    """The least confidence of each document's verdicts."""
    return verdict_rows.groupBy(*keys).agg(F.min("confidence").alias("overall"))


def seal_issues(units: DataFrame, key: str, fallback: str = "") -> DataFrame:
    """Parties (key, agreement, page, role, has_seal, has_signature) with neither seal nor signature."""
    bare = units.where((N.ustrip("role") != "") & ~F.coalesce("has_seal", F.lit(False)) & ~F.coalesce("has_signature", F.lit(False)))
    name = F.coalesce(F.nullif(N.ustrip("agreement"), F.lit("")), F.lit("协议"))
    page = F.coalesce(N.ustrip(F.col("page").cast("string")), F.lit(""))
    return bare.select(key, F.concat(name, F.lit("·"), N.ustrip("role"), F.lit("签章")).alias("item"), F.lit("signature").alias("category"), F.when(page != "", F.concat(F.lit("据落款页图：第 "), page, F.lit(" 页"))).otherwise(fallback).alias("evidence"))


def signer_mismatches(signers: DataFrame, parties: DataFrame, key: str) -> DataFrame:
    """Signers (key, signer) that are no party (key, parties array) and contain none, nor are contained; none without parties."""
    both = signers.join(parties, key).where(F.size(F.filter("parties", lambda p: F.coalesce(p, F.lit("")) != "")) > 0)
    n = N.ws_free("signer")
    known = F.exists("parties", lambda p: F.contains(N.ws_free(p), n) | F.contains(n, N.ws_free(p)))
    return both.where((n != "") & ~F.coalesce(known, F.lit(False)))


def head_parties(signers: DataFrame, identities: DataFrame, key: str) -> DataFrame:
    """The first named party of the signer's side (key, pos, name, role), else the seal's owner."""
    side = identities.withColumn("side", N.role_group("role")).where("side <> ''").groupBy(key, "side").agg(F.min(F.struct("pos", "name")).alias("h"))
    both = signers.withColumn("side", N.role_group("role")).join(side, [key, "side"], "left")
    return both.select(key, "role", "side", F.coalesce("h.name", F.nullif(N.ustrip("owner"), F.lit(""))).alias("party"))


def attach_seal_numbers(parties: DataFrame, identities: DataFrame, key: str) -> DataFrame:
    """Seal numbers of sealed parties (key, pos, role, has_seal, seal_no, seal_text, owner) as identifiers of the head party
    of the same side, else of the seal's owner: (key, party, label, value), each value of a party once, the first place kept."""
    sealed = parties.where(F.coalesce("has_seal", F.lit(False))).withColumn("number", N.seal_number("seal_no", "seal_text")).where("number <> ''")
    who = head_parties(sealed.select(key, "role", "owner").distinct(), identities, key)
    both = sealed.join(who.where("party is not null").groupBy(key, "role").agg(F.min("party").alias("party")), [key, "role"])
    first = both.groupBy(key, "party", F.col("number").alias("value")).agg(F.min("pos").alias("pos"))
    return first.select(key, "party", F.lit("印章").alias("label"), "value", "pos")


def distinct_pages(candidates: DataFrame, *keys: str) -> DataFrame:
    """Pages the candidates of a field stand on, each once, in order of first sight (columns pos, page)."""
    first = candidates.where("page is not null").groupBy(*keys, "page").agg(F.min("pos").alias("p"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "page"))), lambda x: x["page"]).alias("pages"))
