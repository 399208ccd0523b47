import random

import pytest

from sheaf.llm import terms as T

ROWS = [(1, "doc_type", "合同协议"), (2, "doc_type", "保险凭证"), (3, "doc_type", "证明"), (4, "doc_type", "发票票据"), (7, "doc_type", "证件"), (12, "date_label", "生效日"), (16, "date_label", "出生日"), (17, "seal_type", "公章"), (18, "seal_type", "合同专用章"), (21, "seal_type", "法定代表人章")]
FOREST = T.trees(ROWS)


@pytest.mark.parametrize(
    "kind, text, term",
    [
        ("doc_type", " 合·同-协议", 1), ("doc_type", "合協議", 1), ("doc_type", "Cntract", 1), ("doc_type", "【扫描保险凭正】", 2), ("doc_type", "明证", 3), ("doc_type", "件证", 7), ("doc_type", "發票？", 4), ("doc_type", "扫描件", 0), ("doc_type", "", 0), ("doc_type", "??", 0),
        ("date_label", "生日效", 12), ("date_label", "生日", 16), ("date_label", "本单据effectve", 12), ("date_label", "备注", 0), ("seal_type", "（合同专用章(2)）", 18), ("seal_type", "章公", 17), ("seal_type", "电子私章(法人)", 21), ("seal_type", "水渍", 0), ("none", "合同", 0),
    ],
)
def test_meaning(kind, text, term):
    assert T.best(FOREST.get(kind), text)[1] == term


@pytest.mark.parametrize("kind, text, term", [("seal_type", "公草", 17), ("doc_type", "发飘", 4), ("doc_type", "证眀", 0), ("seal_type", "私章", 0), ("doc_type", "电子版协义", 1), ("seal_type", "合冋专用章", 18), ("date_label", "岀生日", 16)])
def test_misspelt_words_are_no_aliases(kind, text, term):
    """One edit is allowed in two characters where the first stays and all words that fit mean one term."""
    assert not any(text in a.split() for of in T.ALIASES.values() for a in of.values())
    assert T.best(FOREST.get(kind), text)[1] == term


def test_metric_and_tree_equal_brute_force():
    r = random.Random(1)
    words = ["".join(r.choice("abcd") for _ in range(r.randrange(0, 7))) for _ in range(120)]
    tree = T.BKTree((w, w) for w in words)
    for _ in range(60):
        a, b, c = (r.choice(words) for _ in range(3))
        assert T.damerau(a, b) == T.damerau(b, a) and T.damerau(a, c) <= T.damerau(a, b) + T.damerau(b, c)
        q, k = "".join(r.choice("abcd") for _ in range(r.randrange(1, 6))), r.randrange(3)
        assert sorted((d, w) for d, w, _ in tree.within(q, k)) == sorted((T.damerau(q, w), w) for w in words if T.damerau(q, w) <= k)
    assert T.damerau("ca", "abc") == 2 and T.damerau("ab", "ba") == 1


def test_broadcast_and_shards_agree(spark):
    terms = spark.createDataFrame(ROWS, "term_id bigint, kind string, term string")
    df = spark.createDataFrame([("doc_type", "合同", 1), ("doc_type", "合同", 1), ("doc_type", None, 2), ("seal_type", "章公", 3), ("seal_type", "??", 4), (None, "x", 5)], "kind string, text string, term_id_before int")
    whole = sorted((r.text, r.term_id) for r in T.match_terms(df, terms, "kind", "text").collect())
    parts = sorted((r.text, r.term_id) for r in T.match_terms(df, terms, "kind", "text", shard_size=3).collect())
    assert whole == parts == [("??", 0), ("x", 0), ("合同", 1), ("合同", 1), ("章公", 17)]
    assert T.match_terms(df.limit(0), terms, "kind", "text").count() == 0
    assert {r.term_id for r in T.match_terms(df, terms.limit(0), "kind", "text").collect()} == {0}


def test_number_of_shards_changes_no_answer(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("甲乙丙丁戊己") for _ in range(n))
    entries = [(k, r.choice(["a", "b"]), word(r.randrange(2, 6))) for k in range(1, 60)] + [(60, "a", "甲甲甲"), (61, "a", "合同书")]
    aliases = {"a": {"甲甲甲": "电子合同书 " + word(3)}}
    terms = spark.createDataFrame(entries, "term_id bigint, kind string, term string")
    values = [(r.choice(["a", "b"]), word(r.randrange(1, 6))) for _ in range(300)] + [("a", "电子合同书")]
    df = spark.createDataFrame(values, "kind string, text string")
    answers = [sorted((r.kind, r.text, r.term_id, r.edits or 0) for r in T.match_terms(df, terms, "kind", "text", shard_size=n, aliases=aliases).collect()) for n in (50_000, 31, 9)]
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) == 301
    assert ("a", "电子合同书", 60, 0) in answers[0]
