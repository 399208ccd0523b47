"""Mapping freely typed values to a reference list with a BK-tree under a true edit metric.

The reference list is extended by an alias dictionary (synonyms, other languages); every entry and alias
is a node of one BK-tree per kind.  The metric is the unrestricted Damerau-Levenshtein distance (a true
metric, so the triangle inequality prunes exactly).  The reference list is cut into shards of a bounded number of
entries, one for a small list; each shard's tree is sent to all tasks, and the shards' winners are merged by the same
rule that picks a winner within a shard, so the number of shards changes no answer.

Edge cases: null values give no row; empty or symbol-only values, and values no entry lies close enough to,
give term 0; repeated rows give one result row; an empty reference list leaves everything unmatched.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.script import plain
from sheaf.sources.tables import materialise, table

# Other words for the reference terms, as people write them.
ALIASES = {
    "doc_type": {
        "合同协议": "合同 合约 协议 协议书 契约 合同类 合同书 合同/协议 HT Contract agreement deal",
        "保险凭证": "保单 保险单 投保单 保险 保险合同凭证 BX policy Insurance",
        "证明": "证明书 证明文件 证明材料 收入证明 在职证明 开具证明 certificate proof",
        "发票票据": "发票 票据 票 收据 增值税发票 FP invoice receipt",
        "报告": "报告书 报告类 检测报告 审计报告 评估报告 汇报 report",
        "旅行资料": "旅游资料 旅行 行程单 酒店预订单 机票 出行 travel itinerary",
        "证件": "身份证件 护照 驾照 营业执照 证照 ID证照 身份证 id passport idcard",
        "其他": "其它 杂项 其他类 other misc",
    },
    "date_label": {
        "签订日": "签订日期 签署日期 签署之日 签约日 签字日 signed signedon datesigned",
        "到期日": "到期日期 到期 终止日期 截止日 届满日 有效期至 合同到期 expiry expires",
        "出具日": "出具日期 开具日期 签发日 证明出具日 issued issuedate",
        "生效日": "生效日期 生效时间 起效日 起保日期 effective effectivedate",
        "交付日": "交付日期 交付时间 交房日 交接日 移交日 delivery deliverydate handover",
        "入职日": "入职日期 入司时间 到岗日 报到日 hiredate",
        "开票日": "开票日期 发票日期 票据日期 invoicedate",
        "出生日": "出生日期 出生年月日 生日 DOB birth birthday",
    },
    "seal_type": {
        "公章": "公司章 单位公章 公司印章 行政章 CompanySeal",
        "合同专用章": "合同章 合约专用章 合同专章 合同专用 ContractSeal",
        "财务专用章": "财务章 财务专章 财务专用 FinanceSeal",
        "发票专用章": "发票章 开票章 发票专用 InvoiceSeal",
        "法定代表人章": "法人章 法人名章 法代章 法定代表人名章 法人公章 私章(法人) LegalRepSeal",
        "人事专用章": "人事章 人力资源章 人事专用 HRSeal",
        "业务专用章": "业务章 承保业务章 业务专用 BusinessSeal",
    },
}
# Words put before or after a term that do not change it.
PREFIXES = ("原件", "扫描", "电子版", "纸质", "本单据", "约定", "原", "圆形", "红色", "旧版", "电子")
SUFFIXES = ("类", "(2)")
NOISE = re.compile(r"[\s\"'“”‘’·・\-—_?？!！:：;；,，。、.【】\[\]<>《》]+")


def key_of(text: str | None) -> str:
    """The comparable form of a typed value: plain characters without spaces and decoration."""
    found = NOISE.sub("", plain(text))
    return found[1:-1] if found.startswith("(") and found.endswith(")") else found


def variants_of(key: str) -> Iterator[str]:
    """The key, then the key without known prefixes and suffixes."""
    seen = [key]
    for form in seen:
        yield form
        for p in PREFIXES:
            if form.startswith(p) and len(form) > len(p) and form[len(p) :] not in seen:
                seen.append(form[len(p) :])
        for s in SUFFIXES:
            if form.endswith(s) and len(form) > len(s) and form[: -len(s)] not in seen:
                seen.append(form[: -len(s)])


def damerau(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: a true metric, counting a swap of neighbours as one edit."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        hit = 0
        row = [far, i] + [0] * len(b)
        rows.append(row)
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), hit
            cost = 0 if x == y else 1
            if not cost:
                hit = j
            row[j + 1] = min(rows[i][j] + cost, row[j] + 1, rows[i][j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return rows[-1][-1]


class BKTree:
    """Entries as nodes; a child hangs under its parent at their distance."""

    def __init__(self, entries: Iterable[tuple[str, object]] = ()):
        self.root: tuple | None = None
        for word, value in entries:
            self.add(word, value)

    def add(self, word: str, value: object) -> None:
        if self.root is None:
            self.root = (word, [value], {})
            return
        node = self.root
        while True:
            d = damerau(word, node[0])
            if d == 0:
                node[1].append(value)
                return
            if d not in node[2]:
                node[2][d] = (word, [value], {})
                return
            node = node[2][d]

    def within(self, word: str, radius: int) -> list[tuple[int, str, object]]:
        """Every entry at most ``radius`` from the word; the triangle inequality prunes the rest."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            entry, values, children = todo.pop()
            d = damerau(word, entry)
            if d <= radius:
                found += [(d, entry, v) for v in values]
            todo += [c for k, c in children.items() if d - radius <= k <= d + radius]
        return found


def allowed(form: str) -> int:
    """Edits allowed in a form: none in one character, one in short words, two in long foreign words."""
    return 0 if len(form) < 2 else 2 if len(form) >= 12 and form.isascii() else 1


def trees(rows: list[tuple[int, str, str]], aliases: dict = ALIASES) -> dict[str, BKTree]:
    """One tree per kind, of the reference terms (rank 0) and their aliases (rank 1)."""
    out: dict[str, BKTree] = {}
    for term_id, kind, term in sorted(rows):
        tree = out.setdefault(kind, BKTree())
        tree.add(key_of(term), (0, term_id))
        for other in aliases.get(kind, {}).get(term, "").split():
            tree.add(key_of(other), (1, term_id))
    return out


def winners(tree: BKTree | None, text: str) -> tuple[tuple[int, int, int, int, int] | None, tuple[int, ...]]:
    """What one shard says of a typed value: its nearest entry (edits, order, stripped, rank, term) or None, and the terms
    (two at most) of two-character words that differ from the value's form in their last character only.

    Of equally near entries first comes one with the same characters, then one the form is a shortening of, then what
    needs no prefix taken off, the term itself before its aliases, the smaller id."""
    if tree is None:
        return None, ()
    found, loose = [], set()
    for stripped, form in enumerate(variants_of(key_of(text))):
        if not form or (stripped and len(form) < 2 and form != "票"):
            continue
        for d, entry, (rank, term) in tree.within(form, allowed(form)):
            same = sorted(form) == sorted(entry)
            if d and not same and min(len(form), len(entry)) <= 2 and not form.isascii():
                if len(form) == len(entry) and form[0] == entry[0]:
                    loose.add(term)
                continue
            if d and not same and form.isascii() and len(form) <= 3:
                continue
            found.append((d, 0 if same else 1 if len(form) < len(entry) else 2, stripped, rank, term))
    return (min(found) if found else None), tuple(sorted(loose)[:2])


def chosen(nearest: tuple | None, loose: set[int]) -> tuple[int | None, int]:
    """(edits, term) of a value from all shards' winners: the nearest entry; else, where all words that share the first of
    two characters mean one term, that term; else none."""
    if nearest:
        return nearest[0], nearest[-1]
    return (1, next(iter(loose))) if len(loose) == 1 else (None, 0)


def best(tree: BKTree | None, text: str) -> tuple[int | None, int]:
    """(edits, term) of the entry meant, looked up in one tree."""
    nearest, loose = winners(tree, text)
    return chosen(nearest, set(loose))


def lookup(rows: list[tuple[int, str, str]], aliases: dict, ddl: str, result, max_memo: int = 100_000):
    """A vectorised function (kind, text) -> ``result`` of what one shard's trees say; repeated values are looked up once."""
    built: dict = {}

    def run(kinds: pd.Series, texts: pd.Series) -> pd.DataFrame:
        if not built:
            built.update(trees=trees(rows, aliases), memo={})
        memo, forest = built["memo"], built["trees"]
        if len(memo) > max_memo:
            memo.clear()
        out = []
        for pair in zip(kinds, texts):
            if pair not in memo:
                memo[pair] = result(*winners(forest.get(pair[0]), pair[1]))
            out.append(memo[pair])
        return pd.DataFrame(out, columns=[c.split()[0] for c in ddl.split(", ")])

    return F.pandas_udf(run, ddl).asNondeterministic()


def match_terms(df: DataFrame, terms: DataFrame, kind: str, text: str, shard_size: int = 50_000, aliases: dict = ALIASES) -> DataFrame:
    """``df`` with ``edits`` and ``term_id`` (0: unmatched) of each non-null ``text``.

    The reference list is read in shards of about ``shard_size`` entries by a hash.  With one shard every row is looked up
    where it is.  With more, the distinct values are looked up in each shard's trees in turn, spread over all tasks and
    without a shuffle, and the shards' winners are merged by value."""
    df = df.where(F.col(text).isNotNull())
    terms = terms.where("term is not null").select("term_id", "kind", "term")
    n = max(1, -(-terms.count() // shard_size))
    shard = lambda k: [tuple(r) for r in terms.where(F.pmod(F.xxhash64("kind", "term"), F.lit(n)) == k).collect()]  # noqa: E731  # bounded by about shard_size
    if n == 1:
        hit = lookup(shard(0), aliases, "edits int, term_id bigint", lambda nearest, loose: chosen(nearest, set(loose)))
        return df.withColumn("_hit", hit(F.col(kind), F.col(text))).select("*", "_hit.edits", "_hit.term_id").drop("_hit")
    values = materialise(df.select(F.col(kind).alias("kind"), F.col(text).alias("text")).distinct(), "values")
    parts = [values.withColumn("w", lookup(shard(k), aliases, "e int, p int, s int, r int, t bigint, loose array<bigint>", lambda nearest, loose: (*(nearest or (None,) * 5), list(loose)))("kind", "text")) for k in range(n)]
    won = reduce(DataFrame.unionByName, parts).select("kind", "text", F.when(F.col("w.e").isNotNull(), F.struct("w.e", "w.p", "w.s", "w.r", "w.t")).alias("nearest"), "w.loose")
    won = won.groupBy("kind", "text").agg(F.min("nearest").alias("nearest"), F.array_distinct(F.flatten(F.collect_list("loose"))).alias("loose"))  # two terms a shard at most
    one = F.size("loose") == 1
    edits, term = F.coalesce("nearest.e", F.when(one, 1)), F.coalesce("nearest.t", F.when(one, F.col("loose")[0]), F.lit(0))
    won = won.select(F.col("kind").alias(kind), F.col("text").alias(text), edits.cast("int").alias("edits"), term.cast("bigint").alias("term_id"))
    return df.join(won, [kind, text], "left").fillna({"term_id": 0})


FIELDS = (("archive_documents", "doc_type", "doc_type"), ("labeled_dates", "label", "date_label"), ("document_seals", "seal_type", "seal_type"))


def typed_values(spark: SparkSession, folder: str) -> DataFrame:
    """field_name, row_id, kind, text of the three typed fields."""
    parts = [table(spark, folder, t).select(F.lit(f"{t}.{c}").alias("field_name"), F.col("id").alias("row_id"), F.lit(k).alias("kind"), F.col(c).alias("text")) for t, c, k in FIELDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each typed value that is not exactly a term of its kind, with the term meant (0: none)."""
    terms = table(spark, folder, "canon_terms")
    cases = typed_values(spark, folder).join(F.broadcast(terms.select("kind", F.col("term").alias("text"))), ["kind", "text"], "left_anti")
    return match_terms(cases, terms, "kind", "text").select("field_name", "row_id", "term_id").distinct()


def p2_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The values no entry fits, with how often each occurs."""
    terms = table(spark, folder, "canon_terms")
    counts = typed_values(spark, folder).where("text is not null").groupBy("field_name", "kind", "text").agg(F.count("*").alias("n"))
    return match_terms(counts, terms, "kind", "text").where("term_id = 0").select("field_name", "text", "n")
