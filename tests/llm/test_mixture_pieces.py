import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import mixture as M
from sheaf.llm import pieces as P
from sheaf.llm.tokens import count_tokens, encoding


def test_flight_keeps_the_totals():
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 50, 700):
        p, size = np.full(n, 0.37), r.integers(1, 5000, n).astype(float)
        x = np.column_stack([np.ones(n), size / size.mean()])
        q = M.flight(p, x)
        open_ = (q > 1e-9) & (q < 1 - 1e-9)
        assert open_.sum() <= 2 and ((q >= 0) & (q <= 1)).all()
        assert np.allclose(x.T @ q, x.T @ p, atol=1e-6 * n)


def test_inclusion_probabilities_are_kept():
    size = np.array([5.0, 9, 2, 7, 4, 8, 3, 6])
    hits = np.zeros(8)
    rng = np.random.default_rng
    old, k = np.random.default_rng, iter(range(10**6))
    np.random.default_rng = lambda *_: rng(next(k))
    try:
        for _ in range(3000):
            q = M.flight(np.full(8, 0.4), np.column_stack([np.ones(8), size / size.mean()]))
            hits += q
    finally:
        np.random.default_rng = old
    assert np.abs(hits / 3000 - 0.4).max() < 0.05


def test_mix_shares_and_caps(spark):
    r = random.Random(6)
    docs = [(k, s, r.randrange(20, 900)) for k, s in enumerate(["a"] * 3000 + ["b"] * 400 + ["c"] * 60 + ["x"] * 20)] + [(9001, None, 50), (9002, "a", 0)]
    d = spark.createDataFrame([(*x, 7) for x in docs], "doc_id bigint, source string, n_tokens bigint, copies int")
    w = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("gone", 0.0, 1)], "source string, target_share double, max_repeats int")
    chosen, _ = M.mix(d, w, block=500)
    rows = chosen.collect()
    assert len({x.doc_id for x in rows}) == len(rows)
    total = sum(x.n_tokens * x.copies for x in rows)
    for source, share, cap in (("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)):
        mine = [x for x in rows if x.source == source]
        assert sum(x.n_tokens * x.copies for x in mine) / total == pytest.approx(share, abs=0.005)
        assert max(x.copies for x in mine) <= cap
    assert {x.source for x in rows} == {"a", "b", "c"}
    assert M.mix(d.limit(0), w)[0].count() == 0
    assert M.mix(d, w.limit(0))[0].count() == 0


def long_text(r):
    parts = []
    for _ in range(r.randrange(3, 12)):
        parts.append(r.choice(["", "第3条 付款\n", "# 标题\n", "Clause 4: bay\n"]) + r.choice(["供货方应逐项补正原始行程单，并以最近一次为准。" * r.randrange(1, 40), "the keeper shall inspect the ledger; and more. " * r.randrange(1, 60), "A1 | 2 | 3 | " * r.randrange(1, 90), "长" * r.randrange(1, 900), "é" * 300 + "🙂" * 40]))
    return r.choice(["\n", "\n\n"]).join(parts)


def test_pieces_round_trip():
    e, r = encoding(), random.Random(8)
    for limit, overlap in ((300, 40), (64, 8)):
        for _ in range(25):
            t = long_text(r)
            got = P.split_text(t, limit, overlap)
            if len(e.encode_ordinary(t)) <= limit:
                assert got == []
                continue
            at = 0
            for n, (shared, new, end, k) in enumerate(got):
                assert new == at and end > new and shared <= new
                at = end
                assert k == len(e.encode_ordinary(t[shared:end])) <= limit
                if n:
                    assert overlap <= len(e.encode_ordinary(t[shared:new])) <= overlap + 3
            assert at == len(t)


def test_cuts_at_the_highest_boundary_that_fits():
    section = "供货方应逐项补正原始行程单，并以最近一次为准。" * 10 + "\n"
    t = "".join(f"第{k}条 付款\n{section}" for k in range(1, 7))
    size = len(encoding().encode_ordinary(f"第1条 付款\n{section}"))
    got = P.split_text(t, 2 * size + 30, 20)
    assert all(t[new:].startswith("第") for _, new, _, _ in got) and len(got) == 3


def part(name, sub, n):
    return f"# Part {name}\n\nintroduction to this part\n\n" + "".join(f"### {name}{k}\n\n" + "the keeper shall inspect the ledger and report. " * n + "\n\n" for k in range(1, sub + 1))


def test_parts_before_their_subsections():
    t = part("A", 2, 50) + part("B", 3, 50) + part("C", 2, 50)
    got = P.split_text(t, 2000, 100)
    assert [t[new : new + 8] for _, new, _, _ in got] == ["# Part A", "# Part B", "# Part C"]


def test_chapters_before_clauses_and_outer_before_inner_items():
    body = "供货方应逐项补正原始行程单，并以最近一次为准。" * 12 + "\n"
    t = "".join(f"第{c}章 总则\n" + "".join(f"第{k}条 付款\n{body}" for k in range(1, 4)) for c in "一二三")
    size = len(encoding().encode_ordinary(t)) // 3
    assert [t[new : new + 3] for _, new, _, _ in P.split_text(t, size * 5 // 4 + 40, 20)] == ["第一章", "第二章", "第三章"]
    items = "".join(f"- item {k}\n" + "".join(f"    - detail {k}{j} " + "of the ledger " * 30 + "\n" for j in range(4)) for k in range(6))
    assert all(items[new : new + 7] == "- item " for _, new, _, _ in P.split_text(items, 600, 20))


def highest(text, marks, at):
    return next((r for p, r in marks if p == at), 1000)


def test_no_cut_has_a_higher_boundary_in_reach():
    """Brute force: a node that fits whole is never cut unless crumbs were merged."""
    r = random.Random(5)
    for _ in range(40):
        t = "".join(r.choice(["# ", "## ", "### "]) + f"h{k}\n\n" + "the keeper shall inspect. " * r.randrange(5, 60) + "\n\n" for k in range(12))
        room, limit = 400, 440
        ruler, marks = P.Ruler(t, None, 55), P.marks_of(t)
        parts = P.pack(ruler, marks, 0, len(t), room)
        assert [b for _, b in parts[:-1]] == [a for a, _ in parts[1:]] and all(ruler.size(a, b) <= room for a, b in parts)
        heads = [(p, k) for p, k in marks if k <= 6]
        for _, cut in parts[:-1]:
            for i, (p, k) in enumerate(heads):
                end = next((q for q, j in heads[i + 1 :] if j <= k), len(t))
                if p < cut < end and ruler.size(p, end) <= room:
                    crumbs = [x for x in parts if x[1] == cut or x[0] == cut]
                    assert any(ruler.size(x, y) < room // 8 for x, y in zip(sorted({q for q, _ in heads}), sorted({q for q, _ in heads})[1:] + [len(t)])) or not crumbs


def test_frame(spark):
    rows = [(1, "短文", "z"), (2, None, "z"), (3, "", "z"), (4, "长句子，" * 3000, "z"), (4, "长句子，" * 3000, "z"), (5, "a" * 3000, "z"), (6, "字" * 40_000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, piece_no string")
    got = P.split_documents(df).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_tokens").alias("m")).collect()
    assert {r.doc_id for r in got} == {4, 6} and all(r.m <= 3000 for r in got)
    counts = {r.doc_id: r.n for r in df.select("doc_id", count_tokens("text").alias("n")).collect()}
    assert counts[2] is None and counts[3] == 0 and counts[4] > 3000 >= counts[5]
    assert P.split_documents(df.limit(0)).count() == 0
