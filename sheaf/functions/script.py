"""Character knowledge shared by the text operators: traditional forms, Han test, light normalising."""

from __future__ import annotations

import re
import unicodedata

# Traditional characters and, at the same place, their simplified forms.
TRADITIONAL = (
    "備傳務啟啓孫寧嶽東棲業澤璽療發蒼藍設責貿農醫鈞銘銳錦鐘長門雲風馳駿鴻鵬鶴鷺財險憑證據報協議合同專"
    "證資單開審評書簽訂職員營執讓買賣權買車間場廠產動運輸飲館療養環術機構網絡電腦軟體實國際聯團萬億圓壹貳參陸"
    "張陳劉楊趙黃吳許鄧馮蕭鄭謝韓葉蘇盧蔣賈鄒閻韋馬羅龍賀顧龔錢湯譚歐陽諸長濮聞單鍾鄔慶華豐瑞麗偉傑鳳蘭強軍衛紅"
    "驍驥駒騫騦驄驛羅馬駕蕩綠緯紹緒繼續維約納紅紀級純經濟濱灣潯瀾渦湧滬"
)
SIMPLIFIED = (
    "备传务启启孙宁岳东栖业泽玺疗发苍蓝设责贸农医钧铭锐锦钟长门云风驰骏鸿鹏鹤鹭财险凭证据报协议合同专"
    "证资单开审评书签订职员营执让买卖权买车间场厂产动运输饮馆疗养环术机构网络电脑软体实国际联团万亿圆壹贰叁陆"
    "张陈刘杨赵黄吴许邓冯萧郑谢韩叶苏卢蒋贾邹阎韦马罗龙贺顾龚钱汤谭欧阳诸长濮闻单钟邬庆华丰瑞丽伟杰凤兰强军卫红"
    "骁骥驹骞骦骢驿罗马驾荡绿纬绍绪继续维约纳红纪级纯经济滨湾浔澜涡涌沪"
)
T2S = str.maketrans(TRADITIONAL, SIMPLIFIED)
INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")


def simplify(text: str) -> str:
    """Traditional characters of the list above to simplified ones; everything else unchanged."""
    return text.translate(T2S)


def plain(text: str | None) -> str:
    """NFKC, no invisible characters, simplified Han, lower case; '' for null."""
    if not text:
        return ""
    return simplify(INVISIBLE.sub("", unicodedata.normalize("NFKC", text))).casefold()
