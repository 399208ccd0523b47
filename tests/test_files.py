import json

from pyspark.sql import functions as F

from sheaf.operators import evaluation as E
from sheaf.operators import fusion as X
from sheaf.operators import records as R
from sheaf.sources import files as S


def test_document_files(spark, tmp_path):
    for p in ("b.pdf", "sub/a.pdf", ".hidden/c.pdf", "sub/.d.pdf", "e.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    rows = S.document_files(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in rows] == ["b.pdf", "a.pdf"] and len({r.sha256 for r in rows}) == 1
    assert S.document_files(spark, str(tmp_path), limit=1).count() == 1


def test_json_lines_and_append(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"sha": "a", "status": "ok", "new": 1}\n\nbroken\n{"sha": "b"}\n')
    assert [(r.line_no, r.sha, r.status) for r in S.json_lines(spark, str(tmp_path / "log.jsonl")).orderBy("line_no").collect()] == [(0, "a", "ok"), (3, "b", None)]
    out = str(tmp_path / "out")
    for _ in range(2):
        S.append_json_lines(spark.createDataFrame([("x",)], "sha string"), out)
    assert spark.read.json(out).count() == 2


def test_cases(spark, tmp_path):
    for c, names in (("c2", ("gold.json", "input.txt")), ("c1", ("gold.json", "input.txt")), ("c3", ("gold.json",))):
        (tmp_path / c).mkdir()
        for n in names:
            (tmp_path / c / n).write_text("{}\n2")
    assert [(r.case_id, r.text) for r in S.cases(spark, str(tmp_path)).collect()] == [("c1", "{}\n2"), ("c2", "{}\n2")]


def test_registry_file(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text(json.dumps({"version": 2, "parties": {"张三": {"电话": {"value": "1", "role": ""}}}, "aliases": {"张叁": "张三"}}))
    b, a = S.registry_tables(spark, str(good))
    assert [(r.canonical, r.label, r.value) for r in b.collect()] == [("张三", "电话", "1")] and a.head().canonical == "张三"
    bad = tmp_path / "bad.json"
    bad.write_text("{")
    for p in (bad, tmp_path / "none.json"):
        b, a = S.registry_tables(spark, str(p))
        assert b.count() == 0 and a.count() == 0


def test_seal_numbers_to_parties(spark):
    ids = spark.createDataFrame([(1, 0, "甲公司", "出卖人"), (1, 1, "张三", "买受人")], "doc int, pos int, name string, role string")
    parties = spark.createDataFrame([(1, 0, "甲方", True, None, "章 99001122", "误读"), (1, 1, "甲方", True, "99001122", None, None), (1, 2, "见证", True, "7654321", None, "丙"), (1, 3, "乙方", False, "1", None, None), (1, 4, "乙方", True, None, "无号", None)], "doc int, pos int, role string, has_seal boolean, seal_no string, seal_text string, owner string")
    assert sorted((r.party, r.value, r.pos) for r in X.attach_seal_numbers(parties, ids, "doc").collect()) == [("丙", "7654321", 2), ("甲公司", "99001122", 0)]
    c = spark.createDataFrame([("k", 0, 5), ("k", 1, 3), ("k", 2, 5), ("k", 3, None)], "key string, pos int, page int")
    assert X.distinct_pages(c, "key").head().pages == [5, 3]


def test_scores_and_gate(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", None), (None, "b"), (None, "")], "g string, p string")
    assert [tuple(r.s) for r in df.select(E.score_scalar(F.col("g"), F.col("p")).alias("s")).collect()] == [(1, 0, 0), (0, 1, 1), (0, 0, 1), (0, 1, 0), (0, 0, 0)]
    side = lambda rows: spark.createDataFrame(rows, "measure string, mean double, low double")
    got = {r.measure: r.fails for r in E.gate(side([("a", 0.9, 0.8), ("b", 0.9, 0.8), ("parse_rate", 1.0, 1.0)]), side([("a", 0.9, 0.88), ("b", 0.9, 0.86), ("parse_rate", 0.97, 0.9), ("z", 0.0, 0.0)]), 0.03, 0.98).collect()}
    assert got == {"a": False, "b": True, "parse_rate": True}


def test_confidence(spark):
    df = spark.createDataFrame([("t", None, "a", None), (" ", "", "a", "b"), ("t", "s", "a", "b")], "t string, s string, a string, b string")
    c = [F.col(x) for x in "tsab"]
    assert [(r.e, r.w) for r in df.select(R.envelope_confidence(*c).alias("e"), R.share_filled(0.7, c[2], c[3]).alias("w")).collect()] == [(0.6, 0.35), (0.0, 0.7), (0.7, 0.7)]
