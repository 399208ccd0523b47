from fractions import Fraction

import pytest

from sheaf.operators import units as U

FX = {"USD": "7.12", "JPY": "0.048", "HKD": "0.91"}
REFS = U.references(FX)
INDEX = U.SpellingIndex(list(REFS))


def convert(text, unit=None):
    q = U.split_quantity(text, unit)
    if not q:
        return None
    hit = q[1] if q[1] in REFS else (INDEX.nearest(q[1], meaning=lambda r: REFS[r][:2]) or (0, None))[1]
    if hit is None:
        return None
    common, factor, plain = REFS[hit]
    return common, Fraction(q[0]) * factor, plain and not q[2]


@pytest.mark.parametrize(
    "text, unit, common, value, plain",
    [
        ("人民币伍佰贰拾壹万肆仟叁佰贰拾叁元整（¥5,214,323.00）", None, "元", 5214323, True),
        ("人民币柒拾肆万壹仟元整", None, "元", 741000, False),
        ("叁万元伍角", None, "元", Fraction("30000.5"), False),
        ("四十九万七千块钱", None, "元", 497000, False),
        ("￥874000.3", None, "元", Fraction("874000.3"), True),
        ("66,685.00 元整", None, "元", 66685, True),
        ("393.95w元", None, "元", 3939500, False),
        ("CNY 30348k", None, "元", 30348000, False),
        ("RMB 71.88 million", None, "元", 71880000, False),
        ("共69088 分（人民币）", None, "元", Fraction("690.88"), False),
        ("US$94,420", None, "元", Fraction("7.12") * 94420, False),
        ("57340万日元", None, "元", Fraction("0.048") * 573400000, False),
        ("每期7004元／月", "元／月", "元/月", 7004, True),
        ("72.16元/日", None, "元/月", Fraction("72.16") * 365 / 12, False),
        ("41472 RMB p.a.", None, "元/月", 3456, False),
        ("0.15RMB/sq ft/month", "RMB/sq ft/month", "元/月·㎡", Fraction("0.15") / Fraction("0.09290304"), False),
        ("7.2元/平方米/月", None, "元/月·㎡", Fraction("7.2"), True),
        ("10540 元/亩·年", "元/亩·年", "元/月·㎡", Fraction(10540) / 8000, False),
        ("1939元/平方英尺", None, "元/㎡", Fraction(1939) / Fraction("0.09290304"), False),
        ("2470万元/公顷", None, "元/㎡", 2470, False),
        ("16220元/百个/月", "元/百个/月", "元/个/月", Fraction("162.2"), False),
        ("195.7 元/个·月", None, "元/个/月", Fraction("195.7"), True),
        ("573.9", "元/个/季", "元/个/月", Fraction("191.3"), False),
        ("15.6年%", "年%", "%/年", Fraction("15.6"), True),
        ("每日万分之4.1", "万分之/日", "%/年", Fraction("4.1") / 100 * 365, False),
        ("月息1.4分", None, "%/年", Fraction("16.8"), False),
        ("520", "bp/年", "%/年", Fraction("5.2"), False),
    ],
)
def test_cases(text, unit, common, value, plain):
    assert convert(text, unit) == (common, Fraction(value), plain)


@pytest.mark.parametrize("text", [None, "", "面议", "#"])
def test_nothing_to_convert(text):
    assert convert(text) is None


def test_index_equals_scan():
    for s in ("约定#亿", "每期#元/平米·月", "#元 /个 / 季", "#万元 / 年整", "合计#元"):
        scan = [(U.weighted_distance(s, r, 0.75), len(r), r) for r in REFS]
        best = min(x for x in scan if x[0] <= 0.75)
        assert INDEX.nearest(s) == (best[0], best[2])


def test_frame(spark):
    rows = spark.createDataFrame([("a", 1, "￥1.5万", None, "x"), ("a", 1, "￥1.5万", None, "x"), ("a", 2, None, None, "x"), ("a", 3, "0.00005元/日", "", "x"), ("a", 4, "五 elephants", None, "x")], "table_name string, row_id int, text string, unit string, number string")
    fx = spark.createDataFrame([("USD", "美元", "7.12"), (None, None, None)], "currency string, name_zh string, yuan_per_unit string")
    for limit in (100, 0):  # broadcast and shuffled dictionary
        got = {(r.row_id, r.common_unit, r.common_e4) for r in U.convert(rows, fx, limit).collect()}
        assert got == {(1, "元", 150000000), (3, "元/月", 15)}  # 0.5 x 365/12 = 15.2
    assert U.convert(rows.limit(0), fx).count() == 0


@pytest.mark.parametrize("spelling, reference", [("#元/平方木/月", ("元/月·㎡", 1)), ("#万圆正", ("元", 10_000)), ("#milionyuan", ("元", 10**6)), ("#eruo", ("元", 8)), ("#元/平万米", ("元/㎡", 1)), ("#元/公斤/月", None), ("#百万元/月", None), ("#元/吨/月", None), ("#里程", None), ("#元/斤", None)])
def test_misspelt_units(spelling, reference):
    """One character or swap in a longer spelling; what fits several units, or is another kind's unit, stays unmapped."""
    refs = U.references({**FX, "EUR": "8"})
    hit = U.SpellingIndex(list(refs)).nearest(spelling, meaning=lambda r: refs[r][:2])
    assert (refs[hit[1]][:2] if hit else None) == reference


def test_index_equals_brute_force():
    refs = U.references(FX)
    some = sorted(refs)[::97]
    index = U.SpellingIndex(some, common=200)
    for text in [s[:k] + c + s[k + 1 :] for s in some[::23] for k in (1, len(s) // 2) for c in ("每", "木", "")]:
        near = sorted((U.weighted_distance(text, s, 1.75), len(s), s) for s in some)
        d, _, s = near[0]
        hit = index.nearest(text)
        if d <= 0.75:
            assert hit == (d, s)
        elif hit:
            assert hit[0] == d and index.allowed(text)


def test_several_quantities_in_a_text():
    assert [(n, s) for n, s, _ in U.split_quantities("合同价300元，押金600元", None)] == [("300", "合同价#元"), ("600", "押金#元")]
    assert [n for n, _, _ in U.split_quantities("人民币伍佰元整（¥1,500.00）", None)] == ["1500"]
    assert U.split_quantities(None, "元") == [] and U.split_quantities("", None) == []
