"""Evaluation passages in training text by spaced-seed hashing.

Texts become token hashes (letters and digits in words, Han characters one by one; case, width, punctuation and layout
ignored).  A spaced seed is a fixed mask that looks at some token positions of a window and ignores the others, so a
changed character or word at an ignored position leaves the hash as it is.  Passages under ``SHORT`` tokens have lighter,
shorter seeds, and every document that shares one is verified.  Hashes of the passages and of all documents
are joined; around hits the overlap is verified: on each diagonal a stretch is extended while few tokens differ,
stretches on neighbouring diagonals (a token more or less) are chained, and the two longest must give at least
``share`` of the passage.

The passages' hashes are shared with every task up to ``max_broadcast`` of them; beyond that documents' and passages'
hashes meet in a shuffled join, by the same rule.  Edge cases: null and empty texts and passages under 10 tokens match nothing;
repeated documents are each reported; a document is read whole at any length; ties need no order; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.sources.tables import materialise, spread, table

# Spaced seeds: 1 looks at a token, 0 ignores it.  Weight 14 in spans of 20 to 21.
SEEDS = ("11011101011101110111", "111010111011011010111", "110111011010110111011")
#: Seeds of passages under SHORT tokens: weight 6 and 7 in spans of 8 to 10.
LIGHT = ("11101110", "110110111", "1101001111")
SHORT = 80
#: Share of the wanted tokens that the hits of a longer passage must span at most to be verified.
SPANNED = 0.75
_LUT: dict = {}


def lut() -> np.ndarray:
    """Code point -> comparable code point (0: separates words); built once in each process."""
    if "t" not in _LUT:
        import unicodedata

        t = np.zeros(0x110000, np.uint32)
        for c in [*range(0x30, 0x3000), *range(0xF900, 0xFB07), *range(0xFF10, 0xFF5B)]:
            n = unicodedata.normalize("NFKC", chr(c)).casefold()
            if n and n[0].isalnum():
                t[c] = ord(n[0])
        for a, b in ((0x3400, 0x9FFF), (0x20000, 0x2FFFF), (0x3041, 0x30FF), (0xAC00, 0xD7A3)):
            t[a : b + 1] = np.arange(a, b + 1)
        _LUT["t"] = t
        _LUT["powers"] = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
    return _LUT["t"]


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts, start of each text's tokens plus the end)."""
    table_ = lut()
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    codes = table_[np.concatenate(raw)] if len(raw) else np.zeros(0, np.uint32)
    doc = np.repeat(np.arange(len(raw)), sizes)
    live = codes > 0
    han = codes >= 0x3041
    same = np.zeros(len(codes), bool)
    if len(codes) > 1:
        same[1:] = live[1:] & live[:-1] & ~han[1:] & ~han[:-1] & (doc[1:] == doc[:-1])
    head = np.flatnonzero(live & ~same)
    if not len(head):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    index = np.arange(len(codes))
    run = np.maximum.accumulate(np.where(live & ~same, index, 0))
    value = np.where(live, (codes.astype(np.uint64) + np.uint64(0x1F123BB5)) * _LUT["powers"][np.minimum(index - run, 63)], np.uint64(0))
    hashes = np.add.reduceat(value, head)
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    starts = np.searchsorted(head, np.r_[0, np.cumsum(sizes)])
    return hashes, starts


def seed_hashes(x: np.ndarray, starts: np.ndarray, seeds: tuple[str, ...] = SEEDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each seed: (seed, positions, hashes) of the windows that lie within one text."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for k, seed in enumerate(seeds):
        span = len(seed)
        if len(x) < span:
            continue
        at = np.flatnonzero(doc[: len(x) - span + 1] == doc[span - 1 :])
        h = np.full(len(x) - span + 1, k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for j, bit in enumerate(seed):
            if bit == "1":
                h *= np.uint64(0x100000001B3)
                h += x[j : len(x) - span + 1 + j]
                h ^= h >> np.uint64(31)
        yield k, at, h[at]


def seeds_of(size: int) -> tuple[str, ...]:
    return SEEDS if size >= SHORT else LIGHT


def least_hits(size: int, share: float, slack: float) -> float:
    """How many places of a passage must have a hit: those that could span enough of a longer one, one of a short one."""
    return (share - slack) * size * SPANNED / (max(map(len, SEEDS)) + 12) if size >= SHORT else 1.0


class SeedIndex:
    """Sorted seed hashes of the passages by weight of their seeds, each with a bitmap before them."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.x, self.starts = tokens([t or "" for _, t in items])
        self.sizes = np.diff(self.starts)
        self.item = np.repeat(np.arange(len(items)), self.sizes)
        self.parts = []
        for seeds, mine in ((SEEDS, self.sizes >= SHORT), (LIGHT, self.sizes < SHORT)):
            found = [(h[k], at[k]) for _, at, h in seed_hashes(self.x, self.starts, seeds) for k in (mine[self.item[at]],)] if mine.any() else []
            h = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
            if not len(h):
                continue
            p = np.concatenate([f[1] for f in found])
            order = np.argsort(h, kind="stable")
            shift = np.uint64(64 - min(22, max(10, int(len(h) * 16).bit_length())))
            bits = np.zeros(1 << int(64 - shift), bool)
            bits[(h >> shift).astype(np.int64)] = True
            self.parts.append((seeds, h[order], p[order], bits, shift))

    def hits(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in x, position in the passages) of equal seed hashes."""
        xs, ps = [], []
        for seeds, hashes, places, bits, shift in self.parts:
            for _, at, h in seed_hashes(x, starts, seeds):
                maybe = np.flatnonzero(bits[(h >> shift).astype(np.int64)])
                h, at = h[maybe], at[maybe]
                lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                n = hi - lo
                keep = n > 0
                lo, n, at = lo[keep], n[keep], at[keep]
                total = int(n.sum())
                flat = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(total) if total else np.zeros(0, np.int64)
                xs.append(np.repeat(at, n))
                ps.append(places[flat])
        return (np.concatenate(xs), np.concatenate(ps)) if xs else (np.zeros(0, np.int64),) * 2


def stretches(p: np.ndarray, w: np.ndarray, diagonals: np.ndarray, penalty: int = 3, drop: int = 10, least: int = 8) -> list[tuple[int, int, int]]:
    """Best-scoring stretches (from, to in the passage, diagonal): +1 for an equal token, -``penalty`` for another."""
    out = []
    for d in diagonals.tolist():
        a, b = max(0, -d), min(len(p), len(w) - d)
        if b - a < least:
            continue
        gain = np.where(p[a:b] == w[a + d : b + d], 1, -penalty).tolist()
        score = best = start = end = 0
        for k, g in enumerate(gain):
            score += g
            if score <= 0 or score < best - drop:
                if best >= least:
                    out.append((a + start, a + end, d))
                score = best = 0
                start = k + 1
            elif score > best:
                best, end = score, k + 1
        if best >= least:
            out.append((a + start, a + end, d))
    return sorted(out)


def gram_diagonals(p: np.ndarray, w: np.ndarray, n: int = 4) -> np.ndarray:
    """Diagonals on which passage and text share ``n`` tokens in a row.

    With 4 none is missed that holds a stretch: 8 + 3 s equal tokens around s others leave more than 3 in a row; with 3
    none of a short passage's, 5 + 2 s around s."""
    if min(len(p), len(w)) < n:
        return np.zeros(0, np.int64)
    _, ids = np.unique(np.concatenate([p, w]), return_inverse=True)
    width = np.uint64(len(ids) + 1)

    def grams(ids: np.ndarray) -> np.ndarray:
        h = np.zeros(len(ids) - n + 1, np.uint64)
        for k in range(n):
            h = h * width + ids[k : len(ids) - n + 1 + k].astype(np.uint64)
        return h

    mine, theirs = grams(ids[: len(p)]), grams(ids[len(p) :])
    order = np.argsort(mine, kind="stable")
    lo, hi = np.searchsorted(mine[order], theirs, "left"), np.searchsorted(mine[order], theirs, "right")
    return np.unique(np.concatenate([at - order[a:b] for at, a, b in zip(np.flatnonzero(hi > lo), lo[hi > lo], hi[hi > lo])] or [np.zeros(0, np.int64)]))


def two_longest(found: list[tuple[int, int, int]], shift: int = 5, gap: int = 10) -> int:
    """Tokens of the passage in its two longest chained stretches (chained: near diagonals, near each other, in order)."""
    chains: list[list[int]] = []
    for a, b, d in found:
        best = None
        for c in chains:
            if abs(c[2] - d) <= shift and a <= c[1] + gap and b > c[1] and (best is None or c[3] > best[3]):
                best = c
        if best:
            best[3] += b - max(a, best[1])
            best[1], best[2] = b, d
        else:
            chains.append([a, b, d, b - a])
    chains.sort(key=lambda c: -c[3])
    if not chains:
        return 0
    first = chains[0]
    rest = max((c[3] - max(0, min(c[1], first[1]) - max(c[0], first[0])) for c in chains[1:]), default=0)
    return first[3] + max(0, rest)


def leaks_in(texts: list[str], index: SeedIndex, share: float, slack: float = 0.02) -> list[tuple[int, int]]:
    """(text, item) of the passages given in the texts.  ``slack`` allows for tokens lost at a stretch's ends."""
    x, starts = tokens(texts)
    at, place = index.hits(x, starts)
    if not len(at):
        return []
    doc = np.searchsorted(starts, at, "right") - 1
    item = index.item[place]
    diagonal = (at - starts[doc]) - (place - index.starts[item])
    # Hit positions of each (text, item) on distinct places of the passage: an upper bound of what they can cover.
    pair = doc * len(index.ids) + item
    order = np.lexsort((place, pair))
    pair_s, place_s = pair[order], place[order]
    new = np.r_[True, (pair_s[1:] != pair_s[:-1]) | (place_s[1:] != place_s[:-1])]
    pair_u, place_u = pair_s[new], place_s[new]
    span = max(map(len, SEEDS))
    step = np.r_[np.minimum(np.where(pair_u[1:] == pair_u[:-1], place_u[1:] - place_u[:-1], span), span + 12), span + 12]
    ids, first = np.unique(pair_u, return_index=True)
    cover = np.add.reduceat(step, first)
    size = index.sizes[ids % len(index.ids)]
    wanted = ids[(size < SHORT) | (cover >= (share - slack) * size * SPANNED)]
    out = []
    chosen = np.isin(pair, wanted)
    pairs, diagonals = pair[chosen], diagonal[chosen]
    order = np.lexsort((diagonals, pairs))
    pairs, diagonals = pairs[order], diagonals[order]
    for k, lo in zip(*np.unique(pairs, return_index=True)):
        hi = np.searchsorted(pairs, k, "right")
        d, n = np.unique(diagonals[lo:hi], return_counts=True)
        i, j = divmod(int(k), len(index.ids))
        p = index.x[index.starts[j] : index.starts[j + 1]]
        w, least = x[starts[i] : starts[i + 1]], (share - slack) * len(p)
        # Verified on the diagonals of families with 4 hits, then of all hits.  The longer of two stretches is at least
        # half of what is wanted; where there is such a one, the other may be too short for the seeds.  A short passage
        # is looked for on all diagonals at once.
        family = np.cumsum(np.r_[True, np.diff(d) > 5]) - 1
        strong = np.bincount(family, n)[family] >= 4
        if len(p) < SHORT:
            reach = two_longest(stretches(p, w, gram_diagonals(p, w, 3), 2, 6, 5))
        else:
            reach = two_longest(stretches(p, w, d[strong]))
            if reach < least and not strong.all():
                reach = two_longest(stretches(p, w, d))
            if least / 2 <= reach < least:
                reach = two_longest(stretches(p, w, gram_diagonals(p, w)))
        enough = reach >= least
        if enough:
            out.append((i, j))
    return out


def find_leaks(documents: DataFrame, items: DataFrame, share: float = 0.5, max_broadcast: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id) of the passages (item_id, passage) given in documents (doc_id, text)."""
    size = items.select(F.sum(F.length("passage"))).head()[0] or 0
    if not size:
        return documents.select("doc_id", F.lit(None).cast("bigint").alias("item_id")).limit(0)
    if size * len(SEEDS) <= max_broadcast:
        passages = [(r.item_id, r.passage) for r in items.where("passage is not null").select("item_id", "passage").orderBy("item_id").collect()]
        shared = documents.sparkSession.sparkContext.broadcast(passages)
        built: dict = {}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if not built:
                built["index"] = SeedIndex(shared.value)
            for pdf in batches:
                ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
                lo = 0
                while lo < len(texts):
                    hi, chars = lo, 0
                    while hi < len(texts) and (hi == lo or chars + len(texts[hi]) < 1_000_000):
                        chars += len(texts[hi])
                        hi += 1
                    found = leaks_in(texts[lo:hi], built["index"], share)
                    yield pd.DataFrame({"doc_id": [ids[lo + i] for i, _ in found], "item_id": [built["index"].ids[j] for _, j in found]}, dtype="int64")
                    lo = hi

        return spread(documents.where("text is not null and text <> ''").select("doc_id", "text"), 1).mapInPandas(run, "doc_id bigint, item_id bigint")
    return _joined(documents, items, share)


def _joined(documents: DataFrame, items: DataFrame, share: float, slack: float = 0.02) -> DataFrame:
    """The same through a shuffled join of hashes; the verified pairs' texts are joined back by their keys."""

    def hashed(sized: bool):
        """Each text's seed hashes with the number of places that have them; documents have those of both weights."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                keys = pdf.iloc[:, 0].to_numpy()
                x, starts = tokens(pdf.iloc[:, 1].tolist())
                size = np.diff(starts)
                for light, seeds in ((False, SEEDS), (True, LIGHT)):
                    for _, at, h in seed_hashes(x, starts, seeds):
                        row = np.searchsorted(starts, at, "right") - 1
                        keep = (size[row] < SHORT) == light if sized else np.ones(len(row), bool)
                        found = pd.DataFrame({"key": keys[row[keep]], "tokens": size[row[keep]], "h": h[keep].view(np.int64)})
                        yield found.groupby(["key", "tokens", "h"], as_index=False).size().set_axis(["key", "size", "h", "places"], axis=1)

        return run

    ddl = "key bigint, size bigint, h bigint, places bigint"
    clean = documents.where("text is not null and text <> ''").select("doc_id", "text").distinct()
    docs = clean.mapInPandas(hashed(False), ddl).select(F.col("key").alias("doc_id"), "h")
    tests = items.where("passage is not null").select("item_id", "passage").distinct().mapInPandas(hashed(True), ddl).select(F.col("key").alias("item_id"), "size", "h", "places")
    # A hash of a common phrase may be in very many documents: it is split over the documents' side.
    parts = 16
    docs = docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    tests = tests.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("salt", F.col("salt").cast("bigint"))
    enough = F.when(F.col("size") < SHORT, 1.0).otherwise(F.col("size") * (least_hits(1000, share, slack) / 1000))
    pairs = docs.join(tests, ["h", "salt"]).groupBy("doc_id", "item_id", "size").agg(F.sum("places").alias("n")).where(F.col("n") >= enough).select("doc_id", "item_id")
    pairs = materialise(pairs, "leak-pairs")

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for pdf in batches:
            keep = []
            for t, i, p in zip(pdf["text"], pdf["item_id"], pdf["passage"]):
                if (i, p) not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[i, p] = SeedIndex([(i, p)])
                keep.append(bool(leaks_in([t], known[i, p], share, slack)))
            yield pdf.loc[keep, ["doc_id", "item_id"]]

    return pairs.join(clean, "doc_id").join(items.select("item_id", "passage").distinct(), "item_id").mapInPandas(verified, "doc_id bigint, item_id bigint").distinct()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that give at least half of a passage."""
    return find_leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "eval_items").select("item_id", "passage")).distinct()


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents give each passage."""
    return p8_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_docs"))
