import pytest
from pyspark.sql import functions as F

from sheaf.llm import names as N


@pytest.mark.parametrize(
    "a, b",
    [
        ("漱阳市慕霖琮璞科技有限公司", "慕霖琮璞（漱阳）科技有限公"), ("漱阳市慕霖琮璞科技有限公司", "受让方:漱阳慕霖琮璞科技有 限 公 司"), ("漱阳市宸玺鹏琮物业服务有限公司", "漱阳市宸璽鵬琮物業服務（有限公司）（盖章）"), ("漱阳市宸玺鹏琮物业服务有限公司", "宸玺鹏琮物业(漱阳)。"), ("泊宁市镜澜昱渊餐饮管理有限公司", "镜镜澜昱渊餐饮管理(泊宁)（以下简称甲方）"),
        ("Savwenwynlor Textiles Co., Ltd.", "M/s Savwenwynlor Text."), ("Kimvosferfen Property Services Co., Ltd.", "Property Services Co., Ltd. (Kimvosferfen)"), ("Fergalbexcor Logistics", "The FERGALBEXCOR Logs. Co., Limited"),
        ("慕容蘅楹", "慕容 蘅楹先生"), ("屏岫 欧阳", "欧阳屏岫"), ("葉薇", "叶薇"), ("Thomas Murgalgoryae", "Tom W. Murgalgoryae"), ("Ilkvosnorcle, Charlotte", "CHARLOTTE ILKVOSNORCLE"), ("Murgalgoryae Thomas", "Thomas Murgalgoryae"),
    ],
)
def test_same_key(a, b):
    assert N.parse(a)[:3] == N.parse(b)[:3]


@pytest.mark.parametrize("a, b", [("云沐市慕霖琮璞餐饮管理有限公司", "漱阳市慕霖琮璞科技有限公司"), ("丁屏薇", "丁屏荻"), ("Thomas Murgalgoryae", "Robert Murgalgoryae"), ("Brabraclytob Textiles Ltd", "Brabraclytob Engineering Ltd")])
def test_other_key(a, b):
    assert N.parse(a)[:3] != N.parse(b)[:3]


def entities(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "name string, n bigint")
    return {r.name: r.entity for r in N.link_names(df).collect()}


def test_links(spark):
    e = entities(spark, {
        "枫泠市望睿皓璟建筑工程有限公司": 9, "望睿浩璟建筑工程(枫泠)": 1, "望睿皓璟": 1, "望睿皓璟公司": 2,  # homophone, stem alone
        "云沐市慕霖琮璞餐饮管理有限公司": 5, "漱阳市慕霖琮璞科技有限公司": 5, "慕霖琮璞": 1,  # a stem of two lines links neither
        "Jasilklunlun Holdings Co., Ltd.": 4, "Jasilklunllun Hldgs Co., Ltd.": 1, "Joseph Brawenfenjoe": 3, "Joseph Brawenefnjoe": 1, "Ms J Brawenfenjoe": 1, "Brawenfenjoe, J.": 1,
        "丁屏薇": 1, "丁屏荻": 1, "  ": 3, "???": 1,
    })
    assert len({e[n] for n in ("枫泠市望睿皓璟建筑工程有限公司", "望睿浩璟建筑工程(枫泠)", "望睿皓璟", "望睿皓璟公司")}) == 1
    assert e["云沐市慕霖琮璞餐饮管理有限公司"] != e["漱阳市慕霖琮璞科技有限公司"] and "慕霖琮璞" not in e
    assert len({e[n] for n in ("Jasilklunlun Holdings Co., Ltd.", "Jasilklunllun Hldgs Co., Ltd.")}) == 1
    assert len({e[n] for n in ("Joseph Brawenfenjoe", "Joseph Brawenefnjoe", "Ms J Brawenfenjoe", "Brawenfenjoe, J.")}) == 1
    assert e["丁屏薇"] != e["丁屏荻"] and "  " not in e


def test_two_edits_do_not_link(spark):
    e = entities(spark, {"禾墟市屿萃拓棠融资租赁有限公司": 9, "岚皋市屿珩萃棠融资租赁有限公司": 5, "Sormurtanvel Trading Ltd": 4, "Tormurtanvel Trading Ltd": 3})
    assert len(set(e.values())) == 4
    e = entities(spark, {"Sormurtanvel Trading Ltd": 4, "Sormurtavnel Trading Ltd": 1, "Sormurtanel Trading": 1, "Sormurtannvel Trading": 1, "霁州市芷芷蓝鑫农业发展有限公司": 5, "芷止蓝鑫农业发展": 1})
    assert len(set(e.values())) == 2


def test_empty(spark):
    assert entities(spark, {"丁屏薇": 1}) == {"丁屏薇": "p|丁屏薇|-"}
    assert N.link_names(spark.createDataFrame([], "name string, n bigint").withColumn("n", F.col("n"))).count() == 0


def test_nicknames_of_several_names(spark):
    rows = entities(spark, dict([
        ("Charles Brown", 3), ("Charlie Brown", 1), ("Christopher Moore", 2), ("Kit Moore", 1), ("Patrick Lee", 2), ("Pat Lee", 1), ("Alexander Reed", 2), ("Alex Reed", 1), ("Reed, Alex", 1),
        ("Charlotte Hill", 2), ("Charles Hill", 2), ("Charlie Hill", 1), ("Charlie Stone", 1), ("Stone, Charlie", 1), ("Patricia Reed", 1), ("Chuck Stonely", 1), ("Robert Lee", 1),
    ]))
    for a, b in (("Charles Brown", "Charlie Brown"), ("Christopher Moore", "Kit Moore"), ("Patrick Lee", "Pat Lee"), ("Alexander Reed", "Alex Reed"), ("Alex Reed", "Reed, Alex"), ("Charlie Stone", "Stone, Charlie")):
        assert rows[a] == rows[b]
    # A nickname that fits two people of the surname links to neither; other people stay apart.
    assert len({rows[n] for n in ("Charlotte Hill", "Charles Hill", "Charlie Hill")}) == 3
    assert len({rows[n] for n in ("Alexander Reed", "Patricia Reed", "Patrick Lee", "Robert Lee", "Charles Brown", "Charlie Stone", "Chuck Stonely")}) == 7


def test_another_letter_needs_support(spark):
    rows = entities(spark, dict([("Robert Haljordanhoe", 9), ("Robert Haljordunhoe", 1), ("Robert Tobilkwenras", 2), ("Robert Tobilkwanras", 2)]))
    assert rows["Robert Haljordanhoe"] == rows["Robert Haljordunhoe"] and rows["Robert Tobilkwenras"] != rows["Robert Tobilkwanras"]


def test_partitions_change_nothing(spark):
    counted = [(f"{g} {s}", 1 + k % 3) for k, (g, s) in enumerate([(g, s) for g in ("Bob", "Robert", "Kit", "Kate", "Charlie") for s in ("Marlowe", "Marlow", "Haljordan", "Haljordon")])] + [("岫云环保设备有限公司", 2), ("砚城岫云环保", 2), ("（枫泠）岫云环保设备有限公司", 2)]
    df = spark.createDataFrame(counted, "name string, n long")
    whole = sorted(map(tuple, N.link_names(df.coalesce(1)).collect()))
    assert whole == sorted(map(tuple, N.link_names(df.repartition(7)).collect())) == sorted(map(tuple, N.link_names(df.orderBy(F.desc("name")).repartition(3, "n")).collect()))


@pytest.mark.parametrize("query", [N.p3_found, N.p3_entities])
def test_no_table_goes_through_the_driver(spark, tmp_path, query):
    def executions():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = spark._jsparkSession.sharedState().statusStore().executionsList()
        return {x.executionId(): x for x in map(found.apply, range(found.size()))}

    names = [(f"{g} Haljor{s}hoe", f"Tobil{s}wen Trading") for g in ("Robert", "Bob", "R.") for s in ("dan", "dun", "nad", "kil")]
    spark.createDataFrame(names, "party_a string, party_b string").write.parquet(str(tmp_path / "archive_documents.parquet"))
    spark.createDataFrame([("Tobildanwen",), ("Tobilkilwen",)], "owner string").write.parquet(str(tmp_path / "document_seals.parquet"))
    before = executions()
    assert query(spark, str(tmp_path)).collect()
    plans = [x.physicalPlanDescription() for k, x in executions().items() if k not in before]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
