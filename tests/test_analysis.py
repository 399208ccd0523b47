import inspect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.operators import evaluation as E
from sheaf.operators import fusion as X
from sheaf.operators import pages as P
from sheaf.operators import records as R
from sheaf.operators import registry as G

IDENT = "seq string, pos int, ipos int, name string, role string, label string, value string"


def reconcile(spark, rows):
    got = G.reconcile(spark.createDataFrame([(f"{s:04d}", p, i, n, None, l, v) for s, p, i, n, l, v in rows], IDENT)).collect()
    return sorted((r.kind, r.canonical, r.label, r.value, r.base, r.name) for r in got)


def test_first_seen_and_conflict(spark):
    got = reconcile(spark, [(1, 0, 0, "甲方：张三", "身份证号", "1234"), (2, 0, 0, "张三", "身份证号", "1239"), (3, 0, 0, "张三", "电话", "139 1234 5678"), (4, 0, 0, "张三", "电话", "13912345678"), (5, 0, 0, " ", "电话", "1")])
    assert got == [("baseline", "张三", "电话", "139 1234 5678", "", "张三"), ("baseline", "张三", "身份证号", "1234", "", "张三"), ("issue", "张三", "身份证号", "1239", "1234", "张三")]


def test_strong_values_merge_weak_do_not(spark):
    got = reconcile(spark, [(1, 0, 0, "示例置业", "印章", "990011223344"), (2, 0, 0, "示例奥业", "印章", "990011223344"), (3, 0, 0, "示例奥业", "电话", "1"), (4, 0, 0, "甲公司", "开户行", "支行"), (5, 0, 0, "乙公司", "开户行", "支行")])
    assert ("alias", "示例置业", "", "", "", "示例奥业") in got
    assert ("baseline", "示例置业", "电话", "1", "", "示例奥业") in got
    assert {r[1] for r in got if r[2] == "开户行"} == {"甲公司", "乙公司"}


def test_components_fold_equals_one_global_fold(spark):
    r = random.Random(3)
    rows, seen = [], set()
    for s in range(150):
        name, label, value = f"n{r.randrange(25)}", r.choice(["身份证", "印章", "电话"]), f"v{r.randrange(30)}"
        if (name, label, value) not in seen:  # repeats are reduced to the first by design
            seen.add((name, label, value))
            rows.append((s, 0, 0, name, label, value))
    parties, owner, aliases, want = {}, {}, {}, []
    for s, _, _, name, label, value in rows:
        strong = label != "电话"
        key = aliases.get(name) or (name if name in parties else owner.get(value, name) if strong else name)
        if key != name and name not in aliases:
            aliases[name] = key
            want.append(("alias", key, "", "", "", name))
        slot = parties.setdefault(key, {})
        if label not in slot:
            slot[label] = value
            if strong:
                owner.setdefault(value, key)
            want.append(("baseline", key, label, value, "", name))
        elif slot[label] != value:
            want.append(("issue", key, label, value, slot[label], name))
    assert reconcile(spark, rows) == sorted(want)


def test_group_set_remove(spark):
    base = spark.createDataFrame([("张三", "电话", "139 1234 5678", "1"), ("张三", "联系电话", "13912345678", "2"), ("张三", "税号", "9", "3")], "canonical string, label string, value string, seq string")
    assert sorted((r.labels, r.value) for r in G.group_by_value(base).collect()) == [("电话/联系电话", "139 1234 5678"), ("税号", "9")]
    assert G.remove(base, " 张三", "税号").count() == 2 and G.remove(base, "张三").count() == 0
    assert {r.value for r in G.set_value(base, "张三", "税号", "7").where("label = '税号'").collect()} == {"7"}


def test_fusion(spark):
    rows = [("d", "a", "text", 0, "200万元"), ("d", "a", "vision", 0, "200万"), ("d", "b", "text", 0, "1年"), ("d", "c", "text", 0, "张元"), ("d", "c", "vision", 0, "张"), ("d", "e", "text", 0, "x"), ("d", "e", "vision", 0, "y"), ("d", "f", "vision", 0, None)]
    c = spark.createDataFrame(rows, "doc string, key string, source string, pos int, value string")
    judged = spark.createDataFrame([("d", "e", "y", "1.7", None)], "doc string, key string, value string, confidence string, low_confidence boolean")
    got = {r.key: (r.value, r.source, r.confidence, r.low_confidence) for r in X.verdicts(c, "doc", "key", adjudicated=judged).collect()}
    assert got["a"] == ("200万元", "agreed", 0.95, False) and got["b"] == ("1年", "text", 0.7, False)
    assert got["c"] == ("张", "adjudicated", 0.4, True) and got["e"] == ("y", "adjudicated", 1.0, False)
    assert X.overall(X.verdicts(c, "doc", "key"), "doc").head().overall == 0.4
    assert [r.v for r in spark.createDataFrame([(" 无 ",), ("N/A",), (" a",), (None,)], "c string").select(X.candidate_value("c").alias("v")).collect()] == [None, None, "a", None]


def test_signers_and_seals(spark):
    parties = spark.createDataFrame([(1, ["张三（买受人）", "李四"]), (2, []), (3, None)], "doc int, parties array<string>")
    s = spark.createDataFrame([(1, "王五"), (1, "张 三"), (2, "王五"), (3, "王五"), (1, "")], "doc int, signer string")
    assert [(r.doc, r.signer) for r in X.signer_mismatches(s, parties, "doc").collect()] == [(1, "王五")]
    u = spark.createDataFrame([(1, "", 8, "乙方", False, None), (1, "补充协议", None, "甲方", True, False), (1, "x", None, "", False, False)], "doc int, agreement string, page int, role string, has_seal boolean, has_signature boolean")
    assert [(r.item, r.evidence) for r in X.seal_issues(u, "doc").collect()] == [("协议·乙方签章", "据落款页图：第 8 页")]
    ids = spark.createDataFrame([(1, 0, "甲公司", "出卖人"), (1, 1, "张三", "买受人")], "doc int, pos int, name string, role string")
    who = spark.createDataFrame([(1, "乙方", "章主"), (1, "见证", "章主")], "doc int, role string, owner string")
    assert {(r.role, r.party) for r in X.head_parties(who, ids, "doc").collect()} == {("乙方", "张三"), ("见证", "章主")}


def test_fbeta_edges(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 0, 0), (1, 0, 0), (1, 1, 1)], "tp int, fp int, fn int")
    assert [r.f for r in df.select(E.fbeta("tp", "fp", "fn").alias("f")).collect()] == [0.0, 1.0, 1.0, 0.5]


def test_alignment(spark):
    g = spark.createDataFrame([(1, "a", 0, "x"), (1, "a", 1, "y"), (1, "b", 2, None)], "c int, k string, o int, v string")
    p = spark.createDataFrame([(1, "a", 0, "x"), (1, "a", 1, "z"), (1, "b", 2, None), (2, "a", 0, "q")], "c int, k string, o int, v string")
    assert sorted(tuple(r) for r in E.align_exact(g, p, "c", "k", "o", "v").collect()) == [(1, 2, 1, 1), (2, 0, 1, 0)]
    assert E.greedy(["甲方签章", "乙方签章"], ["乙方签章", "甲方章"], 0.6) == (2, 0, 0)
    assert E.greedy([], ["a"], 0.6) == (0, 1, 0)
    f = E.align_fuzzy(g.withColumn("v", F.coalesce("v", F.lit(""))), p.withColumn("v", F.coalesce("v", F.lit(""))), "c", "o", "v")
    assert {r.c: (r.tp, r.fp, r.fn) for r in f.collect()}[2] == (0, 1, 0)


def test_latency_nearest_rank(spark):
    for n in (1, 2, 19, 20, 21, 100):
        v = sorted(random.Random(n).uniform(0, 9) for _ in range(n))
        r = E.latency(spark.createDataFrame([("m", x) for x in v + [None]], "m string, v double"), "m", "v").head()
        assert r.n == n and r.p95 == v[min(n - 1, int(0.95 * n))] and r.p50 == pytest.approx((v[(n - 1) // 2] + v[n // 2]) / 2)


def test_bootstrap(spark):
    r = random.Random(7)
    groups = {"one": [0.25], "two": [0.5, 1.0], "some": [r.random() for _ in range(33)], "many": [float(r.random() < 0.7) for _ in range(4000)]}
    rows = [(k, x) for k, v in groups.items() for x in v] + [("none", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    got = {x.k: x for x in E.bootstrap_by(df, "k", "v").collect()}
    assert set(got) == set(groups) and tuple(got["one"])[1:] == (0.25, 0.25, 0.25)
    for k, v in groups.items():
        mean, x = sum(v) / len(v), got[k]
        assert x["mean"] == pytest.approx(mean) and x.low <= x["mean"] <= x.high
    # The percentile interval of many values is that of the normal distribution.
    v = groups["many"]
    error = 1.96 * (sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v) / len(v)) ** 0.5
    assert got["many"].high - got["many"].low == pytest.approx(2 * error, rel=0.1)
    assert {tuple(x) for x in E.bootstrap_by(df.repartition(5), "k", "v").collect()} == {tuple(x) for x in got.values()}
    means = np.concatenate([E.resampled_means(np.array([0.0, 1.0]), np.array([30, 70]), 250, (0, p)) for p in range(8)])
    assert len(means) == 2000 and abs(means.mean() - 0.7) < 0.01


def test_bootstrap_ci_takes_two_thousand_resamples(spark):
    from sheaf.plans import analysis_queries as Q
    from sheaf.sources.tables import table

    d = "/root/testdata/sf0.001"
    types = dict(table(spark, d, "archive_documents").select("id", "status").distinct().collect())
    scored = Q.date_scores(spark, d).where("tp + fp + fn > 0").select("doc_id", E.fbeta("tp", "fp", "fn").alias("f")).orderBy("doc_id").collect()
    values = {}
    for x in scored:
        if x.doc_id in types:
            values.setdefault(types[x.doc_id], []).append(x.f)
    got = {x.status: (x["mean"], x.low, x.high) for x in Q.bootstrap_ci(spark, d).collect()}
    assert set(got) == set(values) and all(got[k][0] == pytest.approx(sum(v) / len(v)) for k, v in values.items())
    assert inspect.signature(E.bootstrap_by).parameters["n"].default == 2000
    if {"ok", "partial"} <= set(values):
        assert [x.c_low for x in Q.gate_measures(spark, d).collect()] in ([got["ok"][1]], [got["partial"][1]])


def test_amount_rules(spark):
    ddl = "doc_id int, id int, ordering int, label string, value double, unit string, is_total_component boolean, is_installment boolean"
    a = spark.createDataFrame([(1, 1, 0, "总价", 200000.0, None, True, False), (1, 2, 1, "首期", 500000.0, None, False, True), (1, 3, 2, "余款", 150000.0, None, False, True), (2, 4, 0, "总价", 100.0, None, True, False), (2, 5, 1, "a", 60.0, None, False, True), (2, 6, 2, "b", 40.5, None, False, True), (3, 7, 0, "x", 500000.0, None, False, False), (3, 8, 1, "总", 200000.0, None, True, False), (3, 9, 2, "单价", 2.0, "元/㎡", True, False)], ddl)
    assert [(r.doc_id, r.labels, r.over) for r in R.overshooting_instalments(a).collect()] == [(1, "首期＋余款", 450000.0)]
    assert [r.id for r in R.overshooting_items(a).collect()] == [7]
    assert {r.doc_id: r.total for r in R.computed_totals(a).collect()} == {1: 200000.0, 2: 100.0, 3: 200000.0}


def test_monthly_fee(spark):
    a = spark.createDataFrame([(1, 2.25, "元/月·㎡"), (1, 4.55, "元/月·㎡"), (1, 0.8, "元/平方米·月"), (1, 100.0, "元/个/月"), (2, 3.0, "元/月·平方米"), (3, 3.0, "元/月·㎡")], "doc_id int, value double, unit string")
    f = spark.createDataFrame([(1, 0, "套内建筑面积", "200"), (1, 1, "预测建筑面积", "286.92㎡"), (2, 0, "建筑面积", "100"), (3, 0, "分摊建筑面积", "9")], "doc_id int, pos int, label string, value string")
    assert {r.doc_id: r.fee for r in R.monthly_fees(a, R.building_area(f)).collect()} == {1: 2180.59, 2: 300.0}


def test_names_in_text(spark):
    who = spark.createDataFrame([(1, 0, "张 三"), (1, 1, "李四"), (2, 0, "王五")], "doc_id int, pos int, name string")
    text = spark.createDataFrame([(1, "买受人：张\n三"), (2, "")], "doc_id int, text string")
    assert sorted((r.doc_id, r.pos) for r in R.names_in_text(who, text).collect()) == [(1, 0), (2, 0)]


def test_pages(spark):
    df = spark.createDataFrame([(0, "正文" * 60), (1, ""), (2, "短"), (3, "\x01\x02\x03" * 40), (4, None), (5, "表格" * 60)], "page int, text string")
    routed = {r.page: (r.mode, r.reason) for r in P.route(P.text_quality(df), F.col("page") == 5).collect()}
    assert routed[0] == ("text", "native-text") and routed[5] == ("ocr", "table-present")
    assert all(routed[k] == ("ocr", "no-usable-text") for k in (1, 2, 3, 4))
    stats = spark.createDataFrame([(184, 2, 11000, 9500, 9400, 6000), (4, 1, 11000, 9500, 9400, 6000), (3, 3, 4000, 3000, 2900, 1800)], "pages int, w int, chars int, non_ws int, printable int, cjk int").withColumns({"control": F.lit(0), "replacement": F.lit(0)})
    assert [r.u for r in stats.select(P.document_usable("pages", "w").alias("u")).collect()] == [False, False, True]
    md = spark.createDataFrame([(1, "x\n# 甲 \na\n\n## 乙\nb\n"), (2, "none"), (3, None)], "k int, t string")
    assert sorted((r.section, r.level, r.title, r.body) for r in P.sections(md, "k", "t").collect()) == [(1, 1, "甲", "a"), (2, 2, "乙", "b")]
    text = spark.createDataFrame([(1, 1, "o1"), (1, 2, "o2")], "k int, page int, text string")
    routes = spark.createDataFrame([(1, 0, "text"), (1, 1, "ocr"), (1, 2, "text"), (1, 3, "ocr")], "k int, page int, mode string")
    native = spark.createDataFrame([(1, 0, "n0"), (1, 2, "n2")], "k int, page int, text string")
    assert P.merge_pages(routes, text, native, "k").head().text == "n0\n\no1\n\nn2\n\n[page 4 missing]"


def test_find_pages_equals_scan(spark):
    r = random.Random(5)
    blocks = [(1, k, k // 2, "".join(r.choice("甲乙丙丁戊 ") for _ in range(60))) for k in range(12)]
    frags = [(1, i, (blocks[r.randrange(12)][3][r.randrange(40) :][: r.randrange(4, 25)] if i % 2 else "".join(r.choice("甲乙丙") for _ in range(12)))) for i in range(40)]
    want = {}
    for _, i, f in frags:
        f = f.replace(" ", "")
        hit = next((p for w in range(len(f) - 7) for _, _, p, t in blocks if f[w : w + 12] in t.replace(" ", "")), None) if len(f) >= 8 else None
        if hit is not None:
            want[i] = hit
    got = P.find_pages(spark.createDataFrame(frags, "k int, frag_id int, fragment string"), spark.createDataFrame(blocks, "k int, block_pos int, page int, text string"), "k")
    assert {x.frag_id: x.page for x in got.collect()} == want


def test_page_selection_takes_twenty_pages(spark, tmp_path):
    from sheaf.plans.core import QUERIES

    text = "\n\n".join("x" * 80 if i == 7 else f"附件{i}" if i % 2 else f"短{i}" for i in range(30))
    spark.createDataFrame([(1, text), (2, "附件\n\n" * 6 + "附件"), (3, None)], "doc_id bigint, markdown string").write.parquet(str(tmp_path / "pipeline_outputs.parquet"))
    got = sorted((r.doc_id, r.n, r.page, r["rank"]) for r in QUERIES["page_selection"](spark, str(tmp_path)).collect())
    tables, scans = [i for i in range(1, 30, 2) if i != 7], [i for i in range(2, 30, 2)]
    want = [(0, 0)] + [(p, 1) for p in tables] + [(p, 2) for p in scans]
    assert got == [(1, n, *x) for n, x in enumerate(want[:20], 1)] + [(2, n, n - 1, min(n - 1, 1)) for n in range(1, 8)]


def test_components_of_a_long_chain(spark):
    """Names joined one by one settle, however long the chain."""
    from sheaf.operators import registry as G

    rows = [(f"n{k:03}", f"v{j:03}", True) for k in range(70) for j in (k, k + 1)] + [("alone", "w", True), ("weak", "v000", False)]
    got = {r.cname: r.component for r in G.components(spark.createDataFrame(rows, "cname string, cvalue string, strong boolean")).collect()}
    assert {got[f"n{k:03}"] for k in range(70)} == {"n000"} and got["alone"] == "alone" and got["weak"] == "weak"
