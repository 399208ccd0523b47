import random

from sheaf.llm import personal as P

# Characters of given names that stand in no list of the code.
GIVEN = "建国博淑珍兵桂兰志远德胜秋菊凯旋立新嘉豪梓涵沐浩然雨桐子墨诗语俊杰海涛春燕"
SURNAMES = "王李张刘陈杨赵吴周徐孙胡郭林郑"
_r = random.Random(11)
NAMES = sorted({_r.choice(SURNAMES) + "".join(_r.sample(GIVEN, k)) for k in (1, 2, 2, 2) for _ in range(40)}) + ["欧阳建博", "Charlotte Mabdorniskes", "Edward Tolsvik"] * 6
PROSE = "出租方应当逐项核对已作废的票据联次并由经办人在页脚处签注日期 受让人于七月结算时说明上一年度的缴费凭据 保管部门经电话核对后移交产权登记资料 因设备检修暂停使用期间监理单位同意登记水电表底数 申请人不得擅自公示医疗费用汇总表".split()
TEMPLATES = [
    "联系人：{n} {p}；邮箱 {e}。", "买受人{n}，身份证号：{i}，住址：{a}。", "经办：{n}/{p}/{e}。", "{n}、{m}共同到场。", "由代理人{n}（{i}）代为签收。", "据{n}陈述，钥匙交给{n}。", "收件人：{n}；", "{n}先生当面确认，电话{p}。", "后与{n}说明情况；", "现住{a}，手机{p}。", "户名{n}，账号8899849673389217816。", "请将材料发到{e}，单号12000671428。", "订单号19895836058已核销。",
    "统一社会信用代码：990096493841503MAD。", "乙方王某某，电话154****0021。", "申请人于霁月台现场应当退还鹿鸣府34号车位的钥匙。", "Holder {n}, document 941-15-2683, reachable on (555) 012-9448.", "合同编号HT-2023-24396，第5页。", "版本@5.5已替换，附件C2012。",
]


def texts():
    r = random.Random(2)
    out = []
    for k in range(900):
        fill = {"n": r.choice(NAMES), "m": r.choice(NAMES), "p": r.choice(["+86-154-3944-6286", "(0729)17757620", "0729 07391076 转 473", "16168642531"]), "e": r.choice(["sor.orm@zeddra.example", "nor_kim [at] fentan [dot] test", "cly_nis18#hodvel.example"]), "i": r.choice(["680721 19661009 3237", "38011519900609589X", "EK8721340"]), "a": r.choice(["沅浦市云栈路152号7栋542", "东垣区苇塘街三百三十一号", "橘洲大道54弄31号1143室"])}
        t = TEMPLATES[k % len(TEMPLATES)]
        want = {(kind, P.reduce_item(fill[c])) for c, kind in (("n", "name"), ("p", "phone"), ("e", "email"), ("i", "id_number"), ("a", "address")) if "{" + c + "}" in t}
        want |= {("name", P.reduce_item(fill["m"]))} if "{m}" in t else set()
        want |= {("id_number", "941152683"), ("phone", "5550129448")} if "Holder" in t else set()
        out.append((k, r.choice(PROSE) + "。" + t.format(**fill) + r.choice(PROSE) + "。", want))
    return out


def test_held_out_accuracy(spark):
    rows = texts()
    df = spark.createDataFrame([(k, t, "z") for k, t, _ in rows] + [(9001, "", "z"), (9002, None, "z"), (9003, "无" * 60_000, "z")], "row_id int, text string, kind string").where("text is not null")
    got = {r.row_id: {(s.kind, s.item) for s in r.spans} for r in P.find_personal(df).collect()}
    hits = sum(len(got.get(k, set()) & want) for k, _, want in rows)
    assert hits >= 0.97 * sum(len(w) for _, _, w in rows)
    assert hits >= 0.97 * sum(len(v) for v in got.values())
    named = [(k, x) for k, _, want in rows for x in want if x[0] == "name"]
    assert sum(x in got.get(k, set()) for k, x in named) >= 0.95 * len(named)
    assert not got.get(9003)


def test_replaced(spark):
    df = spark.createDataFrame([("联系人：王藜晨 16168642531。", [("name", 4, 7, "x"), ("phone", 8, 19, "y")]), ("无", None)], f"text string, spans array<struct<kind:string,a:int,b:int,item:string>>")
    assert [r.r for r in df.select(P.replaced("text", "spans").alias("r")).collect()] == ["联系人：[NAME] [PHONE]。", "无"]


def test_nothing(spark):
    df = spark.createDataFrame([(1, "无个人信息")], "row_id int, text string")
    assert P.find_personal(df).count() == 0 and P.find_personal(df.limit(0)).columns == ["row_id", "text", "spans"]


def test_any_given_name_is_proposed():
    for given in "建国 博 淑珍 兵 桂兰 志远 德胜 秋菊 嘉豪 梓涵 浩然 雨桐".split():
        text = f"联系人：王{given}，电话见附件。"
        assert ("王" + given) in {text[a:b] for _, a, b, *_ in P.chinese_names(text, [])}


def test_addresses_as_far_as_they_go():
    long = "广东省广州市天河区石牌镇中山大道四百零五号" + "12幢" * 60
    for text, want in ((f"住址：{long}，", [long]), ("现住云栈路152号7栋542，", ["云栈路152号7栋542"]), ("或者寄新圩区橘洲大道四十七号。", ["新圩区橘洲大道四十七号"]), ("lives at Flat 3, 27 Old Mill Lane, Port Harven or", ["Flat 3, 27 Old Mill Lane, Port Harven"]), ("在霁月台现场", [])):
        assert [text[a:b] for a, b in P.addresses(text)] == want


def test_estimate_separates():
    counts = [("phone", "1,1,1,1,0,0,0", 900), ("phone", "1,1,0,1,-1,0,0", 20), ("phone", "-1,-1,0,0,-1,-1,0", 20)]
    odds, p = P.estimate(counts)
    assert p["phone", "1,1,1,1,0,0,0"] > 0.8 > 0.3 > p["phone", "1,1,0,1,-1,0,0"]
    assert odds["phone"][0][4][0] < 0 < odds["phone"][0][0][2]
