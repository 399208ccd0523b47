"""The registry of identities: first seen becomes the baseline, later differences are issues, strong values merge names.

The rules depend on the order of documents, but only within what shares a name or a strong value.  So names and strong
values are joined into components, and each component is folded in order on its own, in parallel across components.

Edge cases: blank names, labels and values are skipped; equal values in another spelling of separators agree; a
conflicting value never becomes a baseline and never merges; ties in order are broken by the positions in the document.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions import normalise as N
from sheaf.sources.tables import materialise

RESULT = "component string, kind string, canonical string, label string, value string, seq string, name string, base string"


def cleaned(identities: DataFrame) -> DataFrame:
    """(seq, pos, ipos, name, label, value) with canonical name and value."""
    rows = identities.withColumns({"cname": N.canon_name("name"), "label": N.ustrip("label"), "value": N.ustrip("value")})
    return rows.where("cname <> '' and label <> '' and value <> ''").withColumns({"cvalue": N.canon_value("value"), "strong": N.is_strong_label("label")})


def first_seen(identities: DataFrame) -> DataFrame:
    """Every value with the first of its (canonical name, label) and whether it differs: the case without merging."""
    rows = cleaned(identities)
    base = rows.groupBy("cname", "label").agg(F.min_by("value", F.struct("seq", "pos", "ipos")).alias("base"))
    rows = rows.join(base, ["cname", "label"])
    return rows.withColumn("conflict", N.canon_value("base") != F.col("cvalue"))


def components(rows: DataFrame) -> DataFrame:
    """(cname, component): names joined by shared strong values, by min-label steps with pointer jumping.

    Each round aggregates to one label a value and one a name, so a value held by very many names is one group's
    minimum; the labels are written to the shared folder each round, which cuts the lineage.  Labels only ever get smaller, so
    the rounds end by themselves."""
    edges = materialise(rows.where("strong").select("cname", "cvalue").distinct(), "registry-edges")
    labels = materialise(rows.select("cname").distinct().withColumn("component", F.col("cname")), "registry-labels")
    while True:
        by_value = edges.join(labels, "cname").groupBy("cvalue").agg(F.min("component").alias("m"))
        near = edges.join(by_value, "cvalue").groupBy("cname").agg(F.min("m").alias("m"))
        stepped = labels.join(near, "cname", "left").select("cname", F.least("component", F.coalesce("m", "component")).alias("component"))
        # Jump: a label that is itself a name takes that name's label.
        jump = stepped.select(F.col("cname").alias("component"), F.col("component").alias("next"))
        fresh = materialise(stepped.join(jump, "component", "left").select("cname", F.least("component", F.coalesce("next", "component")).alias("component")), "registry-labels")
        moved = fresh.join(labels.withColumnRenamed("component", "old"), "cname").where("component <> old").limit(1).count()
        labels = fresh
        if not moved:
            return labels


def fold(rows: pd.DataFrame) -> pd.DataFrame:
    """One component in order: baselines, aliases and issues."""
    parties: dict[str, dict[str, tuple[str, str]]] = {}
    strong_owner: dict[str, str] = {}
    aliases: dict[str, str] = {}
    out = []
    rows = rows.sort_values(["seq", "pos", "ipos"], kind="stable")
    component = rows["component"].iloc[0]
    for (seq, _, name), person in rows.groupby(["seq", "pos", "cname"], sort=False):
        if name in aliases:
            key = aliases[name]
        elif name in parties:
            key = name
        else:
            owners = [strong_owner[v] for v, s in zip(person["cvalue"], person["strong"]) if s and v in strong_owner]
            key = owners[0] if owners else name
        if key != name and aliases.get(name) != key:
            aliases[name] = key
            out.append((component, "alias", key, "", "", seq, name, ""))
        slot = parties.setdefault(key, {})
        for label, value, canon, strong in zip(person["label"], person["value"], person["cvalue"], person["strong"]):
            if label not in slot:
                slot[label] = (value, canon)
                if strong:
                    strong_owner.setdefault(canon, key)
                out.append((component, "baseline", key, label, value, seq, name, ""))
            elif slot[label][1] != canon:
                out.append((component, "issue", key, label, value, seq, name, slot[label][0]))
    return pd.DataFrame(out, columns=["component", "kind", "canonical", "label", "value", "seq", "name", "base"])


def reconcile(identities: DataFrame) -> DataFrame:
    """Baselines, aliases and issues of all identities (seq, pos, ipos, name, label, value).

    A component is one entity's names and values over all documents, so its rows are those of one entity; identical
    repeats of (canonical name, label, value) are reduced to the first before the fold, which leaves its result the same
    but for issues repeated with the same value, reported once."""
    rows = cleaned(identities)
    first = F.min(F.struct("seq", "pos", "ipos", "value", "strong"))
    slim = materialise(rows.groupBy("cname", "label", "cvalue").agg(first.alias("f")).select("cname", "label", "cvalue", "f.*"), "registry-rows")
    joined = slim.join(components(slim), "cname")
    return joined.groupBy("component").applyInPandas(fold, RESULT)


def group_by_value(baselines: DataFrame) -> DataFrame:
    """Labels of one party with the same value as one group, in order of first sight: (canonical, labels, value)."""
    rows = baselines.withColumn("cvalue", N.canon_value("value"))
    seen = F.array_sort(F.collect_list(F.struct("seq", "label", "value")))
    out = rows.groupBy("canonical", "cvalue").agg(seen.alias("g"))
    return out.select("canonical", F.array_join(F.transform("g", lambda x: x["label"]), "/").alias("labels"), F.get("g", F.lit(0))["value"].alias("value"))


def set_value(baselines: DataFrame, canonical: str, label: str, value: str, seq: str = "(manual)") -> DataFrame:
    """Baselines with one value set by hand."""
    fresh = baselines.sparkSession.createDataFrame([(canonical.strip(), label, value, seq)], "canonical string, label string, value string, seq string")
    return remove(baselines, canonical, label).unionByName(fresh)


def remove(baselines: DataFrame, canonical: str, label: str | None = None) -> DataFrame:
    hit = F.col("canonical") == canonical.strip()
    return baselines.where(~(hit & (F.col("label") == label) if label else hit))


def canonical_name(text: str) -> str:
    """The driver-side twin of the name normaliser, for single lookups."""
    roles = reduce(lambda a, b: f"{a}|{b}", N.ROLE_PREFIXES)
    return re.sub(rf"^(?:{roles})(?:\s*[:：、|/\\\-]+\s*|\s+)", "", text.strip())
