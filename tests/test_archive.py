import pytest
from pyspark.sql import functions as F

from sheaf.operators import archive as A

DOC = "id bigint, sha256 string, status string, doc_type string, title string, contract_name string, party_a string, party_b string, amount_cents bigint, sign_date string, expire_date string, auto_renewal int, completeness_status string, ingested_at string, primary_date string, primary_amount_cents bigint, extra string"
OBL = "id bigint, doc_id bigint, actor string, action string, deadline string, ordering int"
SEAL = "id bigint, doc_id bigint, owner string, seal_type string, raw_text string, ordering int"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(
        [
            (1, "aaaa1", "ok", "合同协议", None, "地下车位使用权转让协议", "示例置业有限公司", "张三", 2_000_000, "2025-03-15", "2025-06-20", 1, None, "2025-01-01T00:00:00Z", None, None, "x"),
            (2, "aaab2", "ok", "合同协议", "t", "商铺租赁合同", "李四", "王五", 50_000_000, "2024-08-01", None, None, "incomplete", "2025-01-02T00:00:00Z", None, None, "x"),
            (3, None, "failed", None, None, None, None, None, None, None, None, None, None, None, None, None, None),
        ],
        DOC,
    )


def ids(df):
    return [r.id for r in df.select("id").collect()]


def test_single_filters(docs, spark):
    risks = spark.createDataFrame([(1,), (1,)], "doc_id bigint")
    assert ids(A.search(docs, A.SearchFilter(name="商铺"))) == [2]
    assert ids(A.search(docs, A.SearchFilter(party="张三"))) == [1]
    assert ids(A.search(docs, A.SearchFilter(amount_min=10_000_000))) == [2]
    assert ids(A.search(docs, A.SearchFilter(signed_after="2025-01-01"))) == [1]
    assert ids(A.search(docs, A.SearchFilter(has_risk=True), risks=risks)) == [1]
    assert ids(A.search(docs, A.SearchFilter(auto_renewal=True))) == [1]
    assert ids(A.search(docs, A.SearchFilter(name="", party=""))) == [2, 1, 3]  # newest first, nulls last


def test_child_predicates_hold_on_one_row(docs, spark):
    obl = spark.createDataFrame([(1, 1, "party_b", "a", "2026-05-12", 0), (2, 1, "party_a", "b", "2027-06-30", 1), (3, 1, "both", "c", None, 2)], OBL)
    assert ids(A.search(docs, A.SearchFilter(obligation_actor="party_a", obligation_before="2026-12-31"), obligations=obl)) == []
    assert ids(A.search(docs, A.SearchFilter(obligation_actor="party_a", obligation_after="2027-01-01"), obligations=obl)) == [1]
    assert [r.deadline for r in A.todo(obl, docs).collect()] == ["2026-05-12", "2027-06-30"]
    assert [r.deadline for r in A.todo(obl, docs, include_undated=True).collect()] == ["2026-05-12", "2027-06-30", None]
    with pytest.raises(ValueError):
        A.todo(obl, docs, actor="nobody")


def test_seals(docs, spark):
    seals = spark.createDataFrame([(1, 1, None, "合同专用章", "x", 0), (2, 1, "甲", None, "y", 1)], SEAL)
    assert ids(A.search(docs, A.SearchFilter(has_seal=False), seals=seals)) == [2, 3]
    assert ids(A.search(docs, A.SearchFilter(seal_type="专用"), seals=seals)) == [1]
    assert ids(A.search(docs, A.SearchFilter(seal_type="专用", seal_owner="甲"), seals=seals)) == []
    assert [r.owner for r in A.seal_board(seals, docs).collect()] == ["甲", None]
    full = {r.id: r for r in A.hydrate(docs, spark.createDataFrame([], OBL), seals).collect()}
    assert full[3].seals == [] and full[3].obligations == [] and len(full[1].seals) == 2


def test_lookup_and_order(docs):
    assert ids(A.resolve(docs, "2")) == [2]
    assert ids(A.resolve(docs, "AAAA")) == [1]
    assert ids(A.resolve(docs, "aaa")) == []
    assert ids(A.list_documents(docs, order_by="amount_cents")) == [2, 1, 3]
    with pytest.raises(ValueError):
        A.list_documents(docs, order_by="title")


def test_prefix_lookup_gives_every_match(spark, tmp_path):
    from sheaf.plans.core import QUERIES

    rows = [(i, f"ab{i:04d}" if i < 120 else f"b{i:04d}", f"2025-01-01T00:{i % 60:02d}:00Z") for i in range(130)]
    df = spark.createDataFrame([(*r[:2], *[None] * 11, r[2], None, None, None) for r in rows], DOC)
    df.union(df).write.parquet(str(tmp_path / "archive_documents.parquet"))
    want = [r[0] for r in sorted(rows, key=lambda r: (-int(r[2][14:16]), r[0])) if r[1].startswith("ab")]
    assert ids(QUERIES["prefix_lookup"](spark, str(tmp_path))) == want
    assert ids(A.by_prefix(df, "AB000")) == [9, 8, 7, 6, 5, 4, 3, 2, 1, 0]
    with pytest.raises(ValueError):
        A.by_prefix(df, "ab0")


def test_stats(docs, spark):
    s = A.stats(docs, "2025-06-01").head()
    assert (s.total, s.expiring_within_30d, s.by_status, s.by_sign_month) == (3, 1, {"ok": 2, "failed": 1}, {"2024-08": 1, "2025-03": 1})
    assert A.stats(docs.limit(0), "2025-06-01").head().total == 0


def test_like_folds_ascii_only(spark):
    df = spark.createDataFrame([("ÀB%",), ("a\\b",)], "c string")
    assert df.where(A.ascii_like("c", "b")).count() == 2
    assert df.where(A.ascii_like("c", "à")).count() == 0
    assert df.where(A.ascii_like("c", "\\")).count() == 1


def test_plan_shape(docs, spark):
    obl = spark.createDataFrame([(1, 1, "party_b", "a", "2026-05-12", 0)], OBL)
    plan = A.search(docs, A.SearchFilter(obligation_actor="party_b"), obligations=obl)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


def test_subject_label(spark):
    df = spark.createDataFrame([(["甲", "乙", "丙"], "a", "b"), ([], "a", None), ([], None, None)], "p array<string>, a string, b string")
    assert [r.s for r in df.select(A.subject_label(F.col("p"), F.col("a"), F.col("b")).alias("s")).collect()] == ["甲、乙", "a", ""]
