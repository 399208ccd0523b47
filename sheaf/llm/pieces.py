"""Cutting oversized texts at natural boundaries by packing a structure tree.

A text over the limit is parsed into a tree: sections under headings by their rank (number signs, 编 章 节 条 款, parts and
clauses, depth of numbering), paragraphs at blank lines, list items by indentation, lines; below these sentences, clauses,
table cells or words, and last single pre-tokens.  Only oversized nodes are descended into; sibling subtrees are merged
while they fit, and what an oversized node was cut into is not merged across the node's ends unless it is a crumb (an
eighth of the limit), so every cut is at the highest boundary that the limit allows.  Each piece but the first begins with
the last ``overlap`` tokens of the piece before.

Edge cases: null and empty texts and texts within the limit give no piece; a stretch without any pause is cut between
characters; texts of any length are cut whole; repeated texts are cut alike under each of their ids.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.tokens import encoding
from sheaf.sources.tables import spread, table

_NUM = r"[\d一二三四五六七八九十百零〇]+"
#: Headings and the rank of their sections; the first that matches a line holds.  A rank of None follows from the match.
HEADINGS = (
    (regex.compile(r"#{1,6}(?=\s)"), None),
    (regex.compile(rf"第{_NUM}[编篇部]"), 7), (regex.compile(r"(?:Part|Book|Schedule|Annex|Appendix|Exhibit)\s+\w+\b.{0,60}$|附[件表录]"), 7),
    (regex.compile(rf"第{_NUM}章|Chapter\s+\w+\b.{{0,60}}$"), 8), (regex.compile(rf"第{_NUM}(?:节|部分)|Section\s+\w+\b.{{0,60}}$"), 9),
    (regex.compile(rf"(?:\p{{Han}}{{2,12}})?第{_NUM}条|(?:Article|Clause)\s+\w+\b.{{0,60}}$"), 10), (regex.compile(rf"(?:\p{{Han}}{{2,12}})?第{_NUM}款"), 11),
    (regex.compile(r"[一二三四五六七八九十]+、"), 12), (regex.compile(r"[（(][一二三四五六七八九十]+[)）]"), 13),
    (regex.compile(r"\d+(?:\.\d+)*(?=[.、)]\s|[.、)]?\s+\p{Lu}|、)"), None),
)
PLAIN_HEADING = regex.compile(r"[^\n。.;；|，,]{2,24}$")
LIST_ITEM = regex.compile(r"(?:[-*•·]|\(?[a-z0-9]{1,3}\)|[①-⑳])\s")
PLAIN, PARAGRAPH, ITEM, LINE = 30, 40, 41, 90
#: Boundaries within a line from the highest to the lowest; each matches the text before a cut.
LEVELS = (
    ("sentence", regex.compile(r"[。！？!?]+[”’」』)）]*\s*|(?<=[^\d\s])\.[”’\")]*\s+")),
    ("clause", regex.compile(r"[；;，,：:、]+\s*|\s\|\s*|\t")),
    ("word", regex.compile(r"\s+")),
)


def rank_of(line: str, indent: int, after_blank: bool) -> int:
    """Rank of the node that begins with a line: the smaller, the higher in the tree."""
    for pattern, rank in HEADINGS:
        m = pattern.match(line)
        if m and len(line) <= 100:
            return rank if rank is not None else len(m.group()) if line[0] == "#" else 14 + m.group().count(".")
    if after_blank:
        return PLAIN if PLAIN_HEADING.match(line) and not indent else PARAGRAPH
    if LIST_ITEM.match(line):
        return min(ITEM + indent, LINE - 1)
    return PLAIN + 1 if PLAIN_HEADING.match(line) and not indent else LINE


def marks_of(text: str) -> list[tuple[int, int]]:
    """(place, rank) of every line that begins a node of the structure tree."""
    out, at, blank = [], 0, True
    for line in text.split("\n"):
        body = line.strip()
        if body:
            indent = len(line[: len(line) - len(line.lstrip())].expandtabs(4))
            out.append((at, rank_of(body, indent, blank)))
        blank = not body
        at += len(line) + 1
    return out


@cache
def pretoken():
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


class Ruler:
    """Token counts of stretches that begin and end between pre-tokens, from one pass over the text."""

    def __init__(self, text: str, path: str | None = None, longest: int = 400):
        self.text, e, memo = text, encoding(path), {}
        self.count_of = lambda s: len(e.encode_ordinary(s))
        ends, sums, total = [0], [0], 0
        for m in pretoken().finditer(text):
            parts = [m.group()]
            if len(parts[0]) > longest:  # a run without pause is cut between characters
                parts = [parts[0][k : k + longest] for k in range(0, len(parts[0]), longest)]
            for s in parts:
                if s not in memo:
                    memo[s] = self.count_of(s)
                total += memo[s]
                ends.append(ends[-1] + len(s))
                sums.append(total)
        self.ends, self.sums, self.total = ends, sums, total
        self.at = {p: k for k, p in enumerate(ends)}

    def snap(self, place: int) -> int:
        """The nearest boundary between pre-tokens at or after a place in the text."""
        return self.ends[min(bisect.bisect_left(self.ends, place), len(self.ends) - 1)]

    def size(self, a: int, b: int) -> int:
        return self.sums[self.at[b]] - self.sums[self.at[a]]


def cuts(text: str, a: int, b: int, level: int) -> list[int]:
    """Places within [a, b) where the text may be cut at this level of a line's inside."""
    return [m.end() for m in LEVELS[level][1].finditer(text, a, b) if a < m.end() < b]


def children_of(ruler: Ruler, marks: list[tuple[int, int]], a: int, b: int) -> Iterator[list[int]]:
    """Ever finer ways to cut [a, b): at the highest rank of the tree within it, then at ever lower boundaries."""
    inside = [m for m in marks[bisect.bisect_right(marks, (a, LINE + 1)) : bisect.bisect_left(marks, (b, -1))]]
    for rank in sorted({r for _, r in inside}):
        yield [p for p, r in inside if r <= rank]
    for level in range(len(LEVELS)):
        yield cuts(ruler.text, a, b, level)


def pack(ruler: Ruler, marks: list[tuple[int, int]], a: int, b: int, limit: int) -> list[tuple[int, int]]:
    """Stretches of at most ``limit`` tokens that cover the node [a, b): its children, packed and merged bottom-up."""
    if ruler.size(a, b) <= limit:
        return [(a, b)]
    edges: list[int] = []
    for places in children_of(ruler, marks, a, b):
        edges = sorted({a, *(q for p in places for q in (ruler.snap(p),) if a < q < b), b})
        if len(edges) > 2:
            break
    else:
        k, end = ruler.at[a], ruler.at[b]
        if end - k == 1:
            return [(a, b)]
        edges = ruler.ends[k : end + 1]
    merged: list[tuple[int, int, bool]] = []  # from, to, whether whole children
    for x, y in zip(edges, edges[1:]):
        if ruler.size(x, y) <= limit:
            parts = [(x, y, True)]
        else:
            parts = [(p, q, False) for p, q in pack(ruler, marks, x, y, limit)]
        for p, q, whole in parts:
            if merged and ruler.size(merged[-1][0], q) <= limit:
                first, last, before = merged[-1]
                crumb = min(ruler.size(first, last), ruler.size(p, q)) < limit // 8
                if (whole and before) or crumb:
                    merged[-1] = (first, q, whole and before)
                    continue
            merged.append((p, q, whole))
    return [(p, q) for p, q, _ in merged]


def enough_first(ruler: Ruler, marks: list[tuple[int, int]], parts: list[tuple[int, int]], limit: int, least: int) -> list[tuple[int, int]]:
    """The same stretches, but the first one long enough to be shared from: it takes over from the second, cut at the
    highest boundary that leaves both within the limit, the most even one of a level."""
    if len(parts) < 2 or ruler.size(*parts[0]) >= least:
        return parts
    a, b = parts[0][0], parts[1][1]
    for places in (*children_of(ruler, marks, a, b), ruler.ends[ruler.at[a] + 1 : ruler.at[b]]):
        places = {ruler.snap(p) for p in places}
        fits = [(max(ruler.size(a, p), ruler.size(p, b)), p) for p in places if a < p < b and least <= ruler.size(a, p) <= limit and ruler.size(p, b) <= limit]
        if fits:
            p = min(fits)[1]
            return [(a, p), (p, b), *parts[2:]]
    return parts


def overlap_start(ruler: Ruler, end: int, overlap: int) -> int:
    """Where the stretch before ``end`` of exactly ``overlap`` tokens begins, else the shortest one above."""
    k = ruler.at[end]
    j = k
    while j > 0 and ruler.sums[k] - ruler.sums[j] < overlap:
        j -= 1
    have = ruler.sums[k] - ruler.sums[j]
    if have <= overlap:
        return ruler.ends[j]
    # Part of the pre-token that goes too far: its shortest tail with the tokens still missing.
    missing = overlap - (ruler.sums[k] - ruler.sums[j + 1])
    a, b = ruler.ends[j], ruler.ends[j + 1]
    tails = [(n, p) for p in range(b - 1, a - 1, -1) for n in (ruler.count_of(ruler.text[p:b]),) if n >= missing]
    return min(tails, key=lambda t: (t[0], -t[1]))[1] if tails else a


def split_text(text: str, limit: int = 3000, overlap: int = 200, path: str | None = None) -> list[tuple[int, int, int, int]]:
    """(start of what is shared, start of what is new, end, tokens) of each piece of a text over the limit; else none."""
    ruler = Ruler(text, path, max(1, min(400, limit // 8)))
    if ruler.total <= limit:
        return []
    room, marks = limit - overlap, marks_of(text)
    while True:
        parts = enough_first(ruler, marks, pack(ruler, marks, 0, len(text), room), room, min(overlap, room // 2))
        out = []
        for n, (a, b) in enumerate(parts):
            shared = overlap_start(ruler, a, overlap) if n else a
            out.append((shared, a, b, ruler.count_of(text[shared:b])))
        if all(p[3] <= limit for p in out) or room < 8:
            return out
        room -= max(1, max(p[3] for p in out) - limit)  # merges across a piece's start may cost a token


def split_documents(documents: DataFrame, limit: int = 3000, overlap: int = 200, path: str | None = None) -> DataFrame:
    """Pieces (doc_id, piece_no, shared_from, new_from, to, n_tokens, text) of the documents (doc_id, text) over the limit.

    A token has at least one byte, so texts of at most ``limit`` bytes are left out before Python, exactly."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoding(path)
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                if len(e.encode_ordinary(t)) > limit:
                    rows += [(i, n, s, a, b, k, t[s:b]) for n, (s, a, b, k) in enumerate(split_text(t, limit, overlap, path))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "shared_from", "new_from", "to", "n_tokens", "text"])

    long = spread(documents.where(F.octet_length("text") > limit).select("doc_id", "text"), 1)
    return long.mapInPandas(run, "doc_id bigint, piece_no int, shared_from int, new_from int, to int, n_tokens int, text string")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of more than 3,000 tokens: those the splitter cut."""
    return split_documents(table(spark, folder, "documents")).where("piece_no = 1").select("doc_id").distinct()


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of the oversized documents."""
    return split_documents(table(spark, folder, "documents"))
