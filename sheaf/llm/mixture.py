"""Mixing sources to target shares by balanced sampling (the cube method).

Of each source the expected number of uses m of a document follows from the shares: the mix is made as large as the
repeat caps allow, so one source is used to its cap.  Every document gets floor(m) copies; the fractional rest is drawn
by the cube method: inclusion probabilities move through the null space of the constraints (document and token totals)
until only a few are left fractional, in blocks of bounded size in parallel; what the blocks leave over is blocked again,
and the last few are landed so that the token total is met best.

Edge cases: null texts, empty texts and sources without a weight (also null) are not used and are reported; a weighted
source without documents makes its share impossible: the others keep their proportions; repeated texts under other ids
are documents of their own; an empty table gives an empty mix.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.llm.tokens import count_tokens
from sheaf.sources.tables import materialise, spread, table


def flight(p: np.ndarray, x: np.ndarray, seed: tuple[int, ...] = (0,)) -> np.ndarray:
    """Flight phase: probabilities ``p`` with balancing variables ``x`` (n x q) to 0 or 1, at most q left fractional.

    Works on q + 1 units at a time: their constraints leave a null direction, along which the probabilities move, by
    chance one way or the other with the expectation kept, until one of them is 0 or 1 and the next unit takes its place."""
    p = p.astype(float).copy()
    q = x.shape[1]
    random = np.random.default_rng((len(p), *seed))
    open_ = [i for i in range(len(p)) if 1e-9 < p[i] < 1 - 1e-9]
    window, rest = open_[: q + 1], iter(open_[q + 1 :])
    while len(window) == q + 1:
        a = x[window].T
        u = _null(a)
        w = p[window]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > 1e-12, (1 - w) / u, np.where(u < -1e-12, -w / u, np.inf)))
            down = np.min(np.where(u > 1e-12, w / u, np.where(u < -1e-12, (w - 1) / u, np.inf)))
        w = w + up * u if random.random() < down / (up + down) else w - down * u
        done = []
        for k, i in enumerate(window):
            p[i] = min(1.0, max(0.0, w[k]))
            if p[i] < 1e-9 or p[i] > 1 - 1e-9:
                p[i] = round(p[i])
                done.append(k)
        for k in reversed(done):
            window.pop(k)
        while len(window) < q + 1 and (i := next(rest, None)) is not None:
            window.append(i)
        if not done:
            break
    return p


def _null(a: np.ndarray) -> np.ndarray:
    """A vector that ``a`` (q x (q + 1)) maps to zero."""
    if a.shape == (2, 3):
        u = np.cross(a[0], a[1])
        if np.abs(u).max() > 1e-9 * (1 + np.abs(a).max()):
            return u / np.abs(u).max()
    _, _, v = np.linalg.svd(a)
    return v[-1]


def land(p: np.ndarray, size: np.ndarray, goal: float) -> np.ndarray:
    """Landing: the fractional units taken or not so that the total size comes nearest the goal (largest first)."""
    out = np.where(p > 1 - 1e-9, 1, 0)
    open_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    lack = goal - float((size * out).sum())
    if len(open_) <= 12:
        best = min(range(1 << len(open_)), key=lambda m: (abs(lack - sum(size[i] for k, i in enumerate(open_) if m >> k & 1)), m))
        for k, i in enumerate(open_):
            out[i] = best >> k & 1
        return out
    for i in sorted(open_, key=lambda i: -size[i]):
        if abs(lack - size[i]) <= abs(lack):
            out[i] = 1
            lack -= size[i]
    return out


def _flyer(last: bool):
    """The flight of one block, with the landing in the last round."""

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=False, kind="stable").reset_index(drop=True)  # small ones last: little is left to land
        p, size = pdf["p"].to_numpy(float), pdf["n_tokens"].to_numpy(float)
        x = np.column_stack([np.ones(len(pdf)), size / max(1.0, size.mean())])
        done = flight(p, x, (zlib.crc32(str(pdf["source"].iloc[0]).encode()), int(pdf["block"].iloc[0])))  # blocks draw apart
        if last:
            done = land(done, size, float((p * size).sum()))
        return pdf.assign(p=np.asarray(done, float))[["doc_id", "source", "n_tokens", "p"]]

    return fly


def mix(documents: DataFrame, weights: DataFrame, block: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(documents with ``copies`` > 0, the plan by source) of documents (doc_id, source, n_tokens) and weights
    (source, target_share, max_repeats)."""
    docs = documents.where("n_tokens > 0")
    totals = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    plan = weights.where("target_share > 0").join(totals, "source", "left")
    usable = plan.where("tokens > 0")
    # The largest mix in which no source goes beyond its cap; shares of sources that are not there are left to the others.
    size = F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share")).over(Window.partitionBy(F.lit(1)))  # one row a source
    usable = usable.withColumn("size", size).withColumn("uses", F.least(F.col("size") * F.col("target_share") / F.col("tokens"), F.col("max_repeats").cast("double")))
    usable = usable.withColumn("whole", F.floor(F.col("uses") + 1e-9)).withColumn("part", F.greatest(F.lit(0.0), F.col("uses") - F.col("whole")))
    usable = materialise(usable, "mix-plan")  # one row a source
    held = materialise(docs.join(F.broadcast(usable.select("source", "whole", "part", "docs")) if usable.count() <= 10_000 else usable.select("source", "whole", "part", "docs"), "source"), "mix-docs")
    open_ = held.where("part > 1e-9").select("doc_id", "source", "n_tokens", F.col("part").alias("p"))
    taken = None
    rounds = 0
    counts = {r.source: r.docs for r in usable.where("part > 1e-9").select("source", "docs").collect()}  # one row a source
    while counts:
        last = max(counts.values()) <= block
        blocks = open_.sparkSession.createDataFrame([(s, max(1, -(-n // block))) for s, n in counts.items()], "source string, blocks int")
        blocked = open_.join(F.broadcast(blocks) if len(counts) <= 10_000 else blocks, "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(rounds)), F.col("blocks")))

        flown = materialise(blocked.groupBy("source", "block").applyInPandas(_flyer(last), "doc_id bigint, source string, n_tokens bigint, p double"), "mix-flown")
        sure = flown.where("p > 1 - 1e-9").select("doc_id")
        taken = sure if taken is None else taken.unionByName(sure)
        if last:
            break
        open_ = flown.where("p > 1e-9 and p < 1 - 1e-9")
        counts = {r.source: r.n for r in open_.groupBy("source").agg(F.count("*").alias("n")).collect()}
        rounds += 1
    result = held.select("doc_id", "source", "n_tokens", "whole")
    result = result.join(taken.withColumn("extra", F.lit(1)), "doc_id", "left") if taken is not None else result.withColumn("extra", F.lit(0))
    result = result.withColumn("copies", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int")).where("copies > 0")
    return result.select("doc_id", "source", "n_tokens", "copies"), plan


def sized(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("doc_id", "source", "text").where("text is not null and text <> ''"), 1)
    return docs.select("doc_id", "source", count_tokens("text").alias("n_tokens"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the mix and how often each is used."""
    chosen, _ = mix(materialise(sized(spark, folder), "mix-sized"), table(spark, folder, "source_weights"))
    return chosen


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source, with what it had and what was used; sources without a weight have none."""
    docs = materialise(sized(spark, folder), "mix-sized")
    chosen, plan = mix(docs, table(spark, folder, "source_weights"))
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.sum("copies").alias("uses"), F.max("copies").alias("most_copies"))
    have = docs.groupBy(F.col("source").alias("s")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    rows = have.join(plan.select("source", "target_share", "max_repeats"), F.col("s").eqNullSafe(F.col("source")), "full").select(F.coalesce("s", "source").alias("source"), "target_share", "max_repeats", "tokens", "docs")
    rows = rows.join(used, "source", "left").withColumn("all_tokens", F.sum("used_tokens").over(Window.partitionBy(F.lit(1))))  # one row a source
    return rows.select("source", "target_share", (F.coalesce("used_tokens", F.lit(0)) / F.col("all_tokens")).alias("actual_share"), "max_repeats", "most_copies", "docs", "tokens", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"))
