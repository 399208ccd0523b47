import pytest

from sheaf.llm import lookalike as L


@pytest.mark.parametrize(
    "text, form",
    [
        ("Ｆ1589 ＠", "F1589 @"), ("发​票专⽤章", "发票专用章"), ("Café", "Café"), ("公 章 ", "公 章 "), ("Сlуоѕtјоrdun Ιnѕurаnсе Со., Ltd.", "Clyostjordun Insurance Co., Ltd."), ("编号 Α8524", "编号 A8524"),
        ("ООО «Северный причал»", "ООО «Северный причал»"), ("ООО «Северный причал»", "ООО «Северный причал»"), ("α区仓库", "α区仓库"), ("合同專用章（２）：，", "合同專用章（2）：，"), ("", ""), ("理由", "理由"), ("“引”《书》、。\n", "“引”《书》、。\n"), ("RАЅЅОRΤΑ", "RASSORTA"), ("Cеверный", "Северный"),
    ],
)
def test_form(text, form):
    assert L.one_form(text) == form
    assert L.one_form(form) == form  # the form is stable


def test_suspects_cover_all_changes(spark):
    """Every code point the mapping changes alone is in the JVM's prefilter."""
    points = [chr(c) for c in [*range(1, 0x3100), *range(0xF900, 0xFFFF), *range(0x1D400, 0x1D420), 0xE0001] if not 0xD800 <= c < 0xE000]
    changed = [c for c in points if L.one_form(f"x{c}x") != f"x{c}x" and L.one_form(f"9{c}") != f"9{c}"]
    df = spark.createDataFrame([(c,) for c in changed], "t string")
    assert [r.t for r in df.where(~df.t.rlike(L.SUSPECT)).collect()] == []
    assert len(changed) > 300


def test_classes(spark):
    rows = [(1, "Café Ａ", "z"), (2, "Cafe A", "z"), (3, "Café A", "z"), (4, "Café A", "z"), (4, "Café A", "z"), (5, "", "z"), (6, "长" * 50_000 + "​", "z")]
    df = spark.createDataFrame(rows, "row_id int, text string, extra string")
    got = {r.row_id: r.canonical for r in L.canonical_texts(df).collect()}
    assert got[1] == got[3] == got[4] == "Café A" and got[2] == "Cafe A" and got[5] == "" and got[6] == "长" * 50_000
    assert L.canonical_texts(df.limit(0)).count() == 0


def test_letters_of_rare_scripts():
    for text, form in (("Cօntract", "Contract"), ("ᎪBC", "ABC"), ("sᴍall", "sMall"), ("ⅼist", "list"), ("ɑlpha", "alpha"), ("第Ⅱ期", "第Ⅱ期"), ("հայոց", "հայոց")):
        assert L.one_form(text) == form
