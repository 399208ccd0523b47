import random

import numpy as np

from sheaf.llm import leaks as L

WORDS = [f"w{k}" for k in range(400)]


def case(seed=4):
    r = random.Random(seed)
    items = [(k, " ".join(r.choice(WORDS) for _ in range(80))) for k in range(12)] + [(50, "".join(chr(0x4E00 + r.randrange(900)) for _ in range(120))), (60, "short"), (61, None), (62, "")]
    docs, want = [], set()
    for k in range(200):
        i, passage = items[r.randrange(13)]
        tokens = list(passage) if i == 50 else passage.split()
        share = r.choice([0.0, 0.2, 0.3, 0.6, 0.8, 1.0])
        n = int(len(tokens) * share)
        at = r.randrange(len(tokens) - n + 1)
        part = tokens[at : at + n]
        for _ in range(n // 25):
            part[r.randrange(n)] = "变" if i == 50 else "changed"
        filler = lambda: [chr(0x6000 + r.randrange(900)) for _ in range(60)] if i == 50 else [r.choice(WORDS) for _ in range(60)]
        whole = filler() + part + filler()
        text = "，".join(whole) if i == 50 and k % 2 else ("".join(whole) if i == 50 else (" \n" if k % 3 else "-").join(whole).upper())
        docs.append((k, text))
        if share >= 0.6:
            want.add((k, i))
    return items, docs, want


def test_both_ways_find_exactly_the_leaks(spark):
    items, docs, want = case()
    d = spark.createDataFrame([(*x, "z") for x in docs] + [(900, None, "z"), (901, "", "z")], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, passage string")
    for limit in (4_000_000, 1):
        assert {tuple(x) for x in L.find_leaks(d, i, max_broadcast=limit).collect()} == want
    assert L.find_leaks(d.limit(0), i).count() == 0 and L.find_leaks(d, i.limit(0)).count() == 0


def test_two_stretches_count_together():
    r = random.Random(9)
    passage = [r.choice(WORDS) for _ in range(100)]
    noise = lambda: [r.choice(WORDS) for _ in range(50)]
    index = L.SeedIndex([(1, " ".join(passage))])
    two = " ".join(noise() + passage[:30] + noise() + passage[60:90] + noise())
    one = " ".join(noise() + passage[:30] + noise())
    assert L.leaks_in([two, one], index, 0.5) == [(0, 0)]


def test_a_short_second_stretch_counts():
    r = random.Random(12)
    passage = [f"p{k}" for k in range(82)]
    noise = lambda: [r.choice(WORDS) for _ in range(50)]
    changed = passage[60:75]
    changed[7] = "other"
    texts = [" ".join(noise() + passage[:33] + noise() + x + noise()) for x in (passage[60:75], changed, passage[60:64], [])]
    assert L.leaks_in(texts, L.SeedIndex([(1, " ".join(passage))]), 0.5) == [(0, 0), (1, 0)]


def test_gram_diagonals_hold_every_stretch():
    r = random.Random(3)
    for _ in range(50):
        p, w = (np.array([r.randrange(4) for _ in range(n)]) for n in (40, 90))
        every = L.stretches(p, w, np.arange(-len(p), len(w)))
        assert L.stretches(p, w, L.gram_diagonals(p, w)) == every


def test_tokens_ignore_case_width_and_layout():
    a, _ = L.tokens(["Ab９ 中，文-X"])
    b, _ = L.tokens(["ａB9\n中文 x"])
    assert np.array_equal(a, b) and len(a) == 4
    assert [len(x) for x in L.tokens(["", "..."])] == [0, 3]


def test_seeds_find_changed_tokens():
    """Any two of the masks' windows agree where only ignored places differ."""
    x, starts = L.tokens([" ".join(WORDS[:40])])
    y = x.copy()
    y[[5 + k for k, b in enumerate(L.SEEDS[0]) if b == "0"]] += np.uint64(1)
    mine = {h: set() for h in range(3)}
    for k, at, h in L.seed_hashes(x, starts):
        mine[k] = dict(zip(at.tolist(), h.tolist()))
    for k, at, h in L.seed_hashes(y, starts):
        if k == 0:
            assert dict(zip(at.tolist(), h.tolist()))[5] == mine[0][5]


def given(r, size, share, changed, two):
    """(passage, document that gives so much of it with changed tokens, one that gives too little)."""
    words = [f"w{k}" for k in range(3000)]
    noise = lambda n: [r.choice(words) for _ in range(n)]
    p, n = noise(size), round(size * share)
    a = r.randrange(0, size - n + 1)
    parts = [p[: n // 2], p[n // 2 - n :]] if two else [p[a : a + n]]
    for _ in range(changed):
        part = r.choice(parts)
        part[r.randrange(len(part))] = f"z{r.randrange(99)}"
    return " ".join(p), " ".join(noise(80) + sum((x + noise(30) for x in parts), [])), " ".join(noise(50) + p[: round(size * 0.4)] + noise(50))


GRID = ((30, 0.55, 0, 0), (30, 0.6, 1, 0), (40, 0.6, 1, 0), (40, 0.6, 2, 0), (40, 0.6, 1, 1), (50, 0.6, 2, 0), (60, 0.6, 3, 0), (80, 0.6, 3, 0), (200, 0.55, 5, 1))


def test_short_passages_with_changed_tokens():
    r = random.Random(4)
    for cell in GRID:
        found = 0
        for _ in range(30):
            passage, text, less = given(r, *cell)
            index = L.SeedIndex([(1, passage)])
            found += L.leaks_in([text], index, 0.5) == [(0, 0)]
            assert not L.leaks_in([less], index, 0.5)
        assert found >= 27, cell


def test_both_ways_agree_on_passages_of_any_length(spark):
    r = random.Random(6)
    cases = [given(r, *cell) for cell in GRID for _ in range(3)] + [("too short a passage", "too short a passage", "x")]
    items = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "item_id bigint, passage string")
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(t for c in cases for t in (c[1], c[2], c[1] + " " + c[2]))], "doc_id bigint, text string")
    whole, joined = ({tuple(x) for x in L.find_leaks(docs, items, max_broadcast=limit).distinct().collect()} for limit in (4_000_000, 1))
    assert whole == joined and len(whole) >= 2 * 25
