import json

from pyspark.sql import functions as F

from sheaf import api
from sheaf.operators.archive import SearchFilter
from sheaf.sources import store as S
from sheaf.streaming import ingest as I

DOC = "sha256 string, status string, doc_type string, title string, contract_name string, party_a string, party_b string, amount_cents bigint, sign_date string, expire_date string, auto_renewal int, completeness_status string, ingested_at string, primary_date string, primary_amount_cents bigint"


def doc(sha, name="合同"):
    return (sha, "ok", "合同协议", None, name, "甲", None, 1, None, None, None, None, "2025", None, None)


def test_insert_delete_never_reuses_ids(spark, tmp_path):
    a = api.Archive(spark, str(tmp_path / "store"))
    assert a.search(SearchFilter()).count() == 0 and a.stats("2025-01-01").head().total == 0
    assert a.ingest(spark.createDataFrame([doc("bbbb"), doc("aaaa"), doc("aaaa")], DOC)) == 2
    assert a.ingest(spark.createDataFrame([doc("aaaa", "other"), doc("cccc")], DOC)) == 1
    assert sorted((r.id, r.sha256, r.contract_name) for r in a.documents.collect()) == [(1, "aaaa", "合同"), (2, "bbbb", "合同"), (3, "cccc", "合同")]
    a.store.commit({"obligations": spark.createDataFrame([(1, 3, "both", "x", None, 0), (2, 1, "both", "y", None, 0)], "id bigint, doc_id bigint, actor string, action string, deadline string, ordering int")})
    a.delete("cccc")
    assert a.obligations.count() == 1 and a.documents.count() == 2
    assert a.ingest(spark.createDataFrame([doc("dddd")], DOC)) == 1
    assert a.documents.where("sha256 = 'dddd'").head().id == 4
    a.compact()
    assert a.show("aaaa").head().obligations[0].action == "y"


def test_upsert_and_ids(spark):
    old = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0")], "id int, title string, at string")
    new = spark.createDataFrame([(2, "B", "t1"), (9, "Z", "t1")], "id int, title string, at string").drop("at")
    assert sorted(tuple(r) for r in S.upsert(old, new, "id", keep=("at",)).collect()) == [(1, "a", "t0"), (2, "B", "t0")]
    rows = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("sha256")).repartition(7)
    got = [r.id for r in S.with_ids(rows, 50, "sha256").orderBy("sha256").collect()]
    assert got == list(range(51, 1051))
    assert S.with_ids(rows.limit(0), 5, "sha256").count() == 0


def test_actions_and_failures(spark):
    docs = spark.createDataFrame([("a", "ok"), ("b", "failed")], "sha256 string, status string")
    scan = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "sha256 string")
    assert {r.sha256: r.action for r in S.actions(scan, docs).collect()} == {"a": "skip", "b": "retry", "c": "new", None: "new"}
    df = spark.createDataFrame([("ok", "old"), ("failed", "old"), ("partial", None)], "s string, o string").withColumn("n", F.lit("new"))
    assert [r.d for r in df.select(S.failed_outcome("s", "o", "n").alias("d")).collect()] == ["old", "new", "new"]


def test_streams(spark, tmp_path):
    rows = [(1, "x"), (2, "x"), (3, "y"), (4, None)]
    spark.createDataFrame(rows, "doc_id int, text string").repartition(3).write.parquet(str(tmp_path / "in"))
    s = I.documents_stream(spark, str(tmp_path / "in"), "doc_id int, text string", 1)
    assert I.run_to_table(I.dedup(s)).count() == 2
    lines = [json.loads(r.line) for r in I.Progress.lines(spark.createDataFrame([("f", "ok"), ("g", "failed")], "pdf string, status string")).orderBy("part").collect()]
    assert [x["event"] for x in lines] == ["file_done", "file_done", "summary"] and lines[-1]["ok"] == 1 and lines[-1]["failed"] == 1
    assert [json.loads(r.line)["event"] for r in I.Progress.lines(spark.createDataFrame([], "pdf string, status string")).collect()] == ["summary"]
    ident = "seq string, name string, label string, value string"
    spark.createDataFrame([("1", "甲方：张三", "电话", "1 2"), ("1", "张三", "税号", ""), (None, None, None, None)], ident).write.parquet(str(tmp_path / "id"))
    assert [tuple(r) for r in I.run_to_table(I.first_seen(I.documents_stream(spark, str(tmp_path / "id"), ident))).collect()] == [("张三", "电话", "1 2", "1 2", False)]


def test_settings_and_catalogue(spark):
    got = {r.name: (r.value, r.source) for r in api.settings(spark, {"adaptive": " ", "max_partition_bytes": "7"}).collect()}
    assert got["max_partition_bytes"] == ("7", "given") and got["shuffle_partitions"] == ("4", "session")
    assert api.capabilities(spark).where("query = 'search_flagship' and has_sql").count() == 1


def test_pointer_is_never_absent(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "s"))
    for k in range(3):
        store.commit({"t": spark.range(k + 1)}, high_water=k)
        assert store.table("t").count() == k + 1 and store.state()["high_water"] == k
    assert [p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("CURRENT")] == ["CURRENT"]
    rows = spark.createDataFrame([("k", "a-late", "2025-02"), ("k", "z-first", "2025-01")], "sha256 string, about string, ingested_at string")
    assert store.insert("docs", rows) == 1 and store.table("docs").head().about == "z-first"
    store.compact("docs", 1)
    assert store.table("docs").count() == 1
