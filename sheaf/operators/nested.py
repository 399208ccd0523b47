"""Deeply nested JSON records to linked flat rows by vectorised structural indexing.

A batch of JSON texts is one byte buffer.  Bitmaps of quotes (escaped ones removed by the parity of the backslash run
before them), of brackets and of delimiters are built for the whole buffer; bytes within strings are masked by the
parity of quotes before them; nesting depth is a prefix sum of opening and closing brackets.  Sorting the delimiters
by depth makes every value the span between two neighbours, its place the distance to the opening bracket, its parent
the value that starts at that bracket.  No tree is built and no value is decoded unless it is asked for.

Edge cases: null, empty, unreadable and non-object texts give no rows; a missing or null member gives none; elements
that are not objects count in ``pos`` but give no row; a lone object is element 0; an array kept as JSON text counts
as the array; of repeated keys the last holds; extra members are ignored; exact copies of a row give one set of rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.sources.tables import spread, table

PATHS = (
    ("key_dates",), ("amounts",), ("seals",), ("fields",), ("obligations",), ("person_identities",), ("sub_agreements",), ("field_verdicts",),
    ("completeness", "issues"), ("person_identities", "*", "identifiers"), ("sub_agreements", "*", "seals"), ("field_verdicts", "*", "candidates"),
)
# Kinds of structural bytes: 1 opens, 2 closes, 3 comma, 4 colon.
_KIND = np.zeros(256, np.uint8)
_KIND[[ord("{"), ord("[")]], _KIND[[ord("}"), ord("]")]], _KIND[ord(",")], _KIND[ord(":")] = 1, 2, 3, 4
_OBJECT, _ARRAY, _QUOTE = ord("{"), ord("["), ord('"')


class Index:
    """The values of a buffer of valid JSON texts: for each its text, parent, place, key and span."""

    def __init__(self, data: bytes, starts: np.ndarray):
        buf = np.frombuffer(data, np.uint8)
        self.data, n = data, len(buf)
        quotes = np.flatnonzero(buf == _QUOTE)
        back = np.flatnonzero(buf == 92)
        if len(back):
            # Length of the run of backslashes that ends just before each quote.
            first = np.r_[True, np.diff(back) > 1]
            run_start = back[np.maximum.accumulate(np.where(first, np.arange(len(back)), 0))]
            at = np.searchsorted(back, quotes) - 1
            hit = (at >= 0) & (back[at] == quotes - 1)
            quotes = quotes[~(hit & ((quotes - run_start[at]) % 2 == 1))]
        kinds = _KIND[buf]
        at = np.flatnonzero(kinds)
        text = np.searchsorted(starts, at, "right") - 1
        inside = (np.searchsorted(quotes, at) - np.searchsorted(quotes, starts)[text]) % 2 == 1
        at, text = at[~inside], text[~inside]
        kind = kinds[at]
        depth = np.cumsum((kind == 1).astype(np.int32) - (kind == 2)) + (kind == 2)
        visible = np.flatnonzero(buf > 32)
        follows = lambda p: visible[np.minimum(np.searchsorted(visible, p), len(visible) - 1)]
        colons = at[kind == 4]
        keep = kind != 4
        at, text, kind, depth = at[keep], text[keep], kind[keep], depth[keep]
        order = np.lexsort((at, depth, text))
        at, text, kind = at[order], text[order], kind[order]
        opener = np.maximum.accumulate(np.where(kind == 1, np.arange(len(at)), 0))
        left = np.flatnonzero(kind != 2)
        start = follows(at[left] + 1)
        left, start = left[start < at[left + 1]], start[start < at[left + 1]]  # empty brackets hold no value
        self.text, self.container, self.pos, self.end = text[left], at[opener[left]], left - opener[left], at[left + 1]
        member = buf[self.container] == _OBJECT
        self.key_from, self.key_to = np.where(member, start + 1, 0), np.zeros(len(left), np.int64)
        self.key_to[member] = quotes[np.searchsorted(quotes, start[member]) + 1]
        start = start.copy()
        start[member] = follows(colons[np.searchsorted(colons, self.key_to[member])] + 1)
        self.start, self.first = start, buf[start]
        order = np.argsort(start, kind="stable")
        where = np.searchsorted(start[order], self.container)
        where = np.minimum(where, max(len(order) - 1, 0))
        found = start[order][where] == self.container if len(order) else np.zeros(0, bool)
        self.parent = np.where(found, order[where] if len(order) else 0, -1)

    def members(self, of: np.ndarray, key: str) -> np.ndarray:
        """Values under ``key`` of the objects ``of`` (-1: the texts themselves); the last of repeated keys."""
        want = json.dumps(key).encode()[1:-1]
        mine = np.flatnonzero((self.key_to - self.key_from == len(want)) & np.isin(self.parent, of))
        same = np.array([self.data[a:b] == want for a, b in zip(self.key_from[mine], self.key_to[mine])], bool)
        mine = mine[same] if len(mine) else mine
        last = {int(c): i for i, c in enumerate(self.container[mine])}
        return mine[sorted(last.values())]

    def elements(self, arrays: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.isin(self.parent, arrays))

    def slice(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].rstrip()


def readable(text: bytes) -> bool:
    """Whether the text is one JSON object (the exact check that follows no other path: values are not taken from it)."""
    try:
        return isinstance(json.loads(text, parse_constant=_refuse), dict)
    except (ValueError, RecursionError):
        return False


def _refuse(name: str) -> None:
    raise ValueError(name)


def rows_of(texts: list[tuple[int, bytes, tuple, str, int]], values: bool) -> Iterator[tuple[int, str, int, int, bytes]]:
    """(row, array, parent place, place, value) of each object; texts: (row, JSON object, path, array's name, parent place)."""
    while texts:
        parts, starts, size = [], [], 0
        for _, t, *_ in texts:
            starts.append(size)
            parts.append(t)
            size += len(t)
        ix = Index(b"".join(parts), np.array(starts, np.int64))
        later = []
        jobs: dict[tuple, list[int]] = {}
        for i, (_, _, path, name, parent) in enumerate(texts):
            jobs.setdefault((path, name), []).append(i)
        for (paths, name), which in jobs.items():
            chosen = np.zeros(len(texts), bool)
            chosen[which] = True
            for path in paths if isinstance(paths[0], tuple) else (paths,):
                yield from _walk(ix, texts, chosen, path, name or ".".join(p for p in path if p != "*"), values, later)
        texts = later


def _walk(ix: Index, texts: list, chosen: np.ndarray, path: tuple, name: str, values: bool, later: list) -> Iterator[tuple]:
    found = ix.members(np.array([-1]), path[0])
    found = found[chosen[ix.text[found]]]
    parents = np.array([texts[t][4] for t in ix.text[found]], np.int64)
    rest = path[1:]
    while True:
        asked = np.flatnonzero(ix.first[found] == _QUOTE)
        for k in asked:
            # An array kept as JSON text: indexed in the next pass under the same key.
            i = found[k]
            inner = json.loads(ix.slice(i)).encode()
            key = "*" if path[0] == "*" else path[len(path) - len(rest) - 1]
            wrapped = b'{"' + key.encode() + b'":' + inner + b"}"
            if readable(wrapped):
                later.append((texts[ix.text[i]][0], wrapped, (key, *rest), name, int(parents[k])))
        if rest and rest[0] != "*":
            objects = ix.first[found] == _OBJECT
            held, found = found[objects], ix.members(found[objects], rest[0])
            up = dict(zip(held.tolist(), parents[objects].tolist()))
            parents = np.array([up[p] for p in ix.parent[found].tolist()], np.int64)
            rest = rest[1:]
            continue
        lone = found[ix.first[found] == _OBJECT]
        lone_parents = parents[ix.first[found] == _OBJECT]
        arrays = found[ix.first[found] == _ARRAY]
        up = dict(zip(arrays.tolist(), parents[ix.first[found] == _ARRAY].tolist()))
        items = ix.elements(arrays)
        items = items[ix.first[items] == _OBJECT]
        objects = np.r_[items, lone].astype(np.int64)
        places = np.r_[ix.pos[items], np.zeros(len(lone), np.int64)].astype(np.int64)
        above = np.r_[np.array([up[p] for p in ix.parent[items].tolist()], np.int64), lone_parents].astype(np.int64)
        if not rest:
            for i, p, q in zip(objects.tolist(), above.tolist(), places.tolist()):
                yield texts[ix.text[i]][0], name, p, q, ix.slice(i) if values else b""
            return
        own = dict(zip(objects.tolist(), places.tolist()))
        found = ix.members(objects, rest[1])
        parents = np.array([own[p] for p in ix.parent[found].tolist()], np.int64)
        rest = rest[2:]


def flatten_json(df: DataFrame, key: str, text: str, paths: tuple = PATHS, values: bool = True, chunk_bytes: int = 2_000_000) -> DataFrame:
    """Linked rows (key, array_name, parent_pos, pos[, value]) of the objects in the arrays at ``paths`` of each JSON text.

    Works batch by batch without a shuffle; ``chunk_bytes`` bounds a worker's index arrays, not what is read: a longer
    text is a chunk of its own."""
    kind = df.schema[key].dataType.simpleString()
    ddl = f"{key} {kind}, array_name string, parent_pos int, pos int" + (", value string" if values else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, column = batch.column(0), batch.column(1).cast(pa.large_binary())
            chunk, size = [], 0
            for i, b in enumerate(column):
                t = b.as_py()
                if t and readable(t):
                    t = t.decode().encode()
                    chunk.append((i, t, paths, "", -1))
                    size += len(t)
                if chunk and (size >= chunk_bytes or i == len(column) - 1):
                    yield out(keys, chunk)
                    chunk, size = [], 0
            if chunk:
                yield out(keys, chunk)

    def out(keys: pa.Array, chunk: list) -> pa.RecordBatch:
        found = list(rows_of(chunk, values))
        row, name, parent, pos, value = zip(*found) if found else ([], [], [], [], [])
        columns = [keys.take(pa.array(row, pa.int64())), pa.array(name, pa.string()), pa.array(parent, pa.int32()), pa.array(pos, pa.int32())]
        if values:
            columns.append(pa.array([v.decode() for v in value], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=[key, "array_name", "parent_pos", "pos"] + ["value"] * values)

    return df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, ddl)


# The members of each array's objects, and where its rows hang.
SHAPES = {
    "key_dates": "label string, date string",
    "amounts": "label string, text string, value double, unit string, is_total_component boolean, is_installment boolean, period_start string, period_end string, evidence string",
    "seals": "raw_text string, owner string, seal_type string",
    "fields": "label string, value string",
    "obligations": "actor string, action string, deadline string, evidence string",
    "person_identities": "name string, role string",
    "sub_agreements": "title string, summary string, sign_date string, evidence string",
    "field_verdicts": "key string, value string, source string, confidence double, low_confidence boolean, rationale string",
    "completeness.issues": "item string, category string, detail string, evidence string",
    "person_identities.identifiers": "label string, value string",
    "sub_agreements.seals": "raw_text string, owner string, seal_type string",
    "field_verdicts.candidates": "source string, value string, evidence string, page int",
}


def flat_table(rows: DataFrame, key: str, array_name: str) -> DataFrame:
    """One array's rows as a typed table (key, parent_pos, pos, members)."""
    parsed = rows.where(F.col("array_name") == array_name).select(key, "parent_pos", "pos", F.from_json("value", SHAPES[array_name]).alias("m"))
    return parsed.select(key, "parent_pos", "pos", "m.*")


def envelopes(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "archive_documents").select(F.col("id").alias("doc_id"), "details_json"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each object in an array of the envelopes; exact copies of a document give its rows once."""
    return flatten_json(envelopes(spark, folder), "doc_id", "details_json", values=False).distinct()


def p1_flat(spark: SparkSession, folder: str, array_name: str) -> DataFrame:
    path = next(p for p in PATHS if ".".join(x for x in p if x != "*") == array_name)
    rows = flatten_json(envelopes(spark, folder), "doc_id", "details_json", paths=(path,))
    return flat_table(rows.distinct(), "doc_id", array_name)
