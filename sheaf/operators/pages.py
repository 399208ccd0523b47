"""Pages and layout: text quality, routing, sections, titles, page lookup of fragments, page selection, box scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.normalise import WS, ws_free

PRINTABLE = r"[\x{21}-\x{7e}\x{4e00}-\x{9fff}]"
CJK = r"[\x{4e00}-\x{9fff}]"
CONTROL = r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}&&[^\n\t\r]]"
BLOCK_TYPES = {"text": "paragraph", "title": "title", "table": "table", "image": "figure", "list": "list", "header": "header", "footer": "footer", "page_number": "footer", "equation": "formula", "code": "paragraph", "aside_text": "other"}
SIGNATURE_MARKERS = "签章|委托代理人|经办人"


def count_of(c: Column, pattern: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def text_quality(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with character counters of its text: all, not blank, printable, Han, control, replacement."""
    c = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns(
        {
            "chars": F.length(c),
            "non_ws": F.length(ws_free(c)),
            "printable": count_of(c, PRINTABLE),
            "cjk": count_of(c, CJK),
            "control": count_of(c, CONTROL),
            "replacement": count_of(c, "�"),
        }
    )


def usable(least: int = 50) -> Column:
    """Whether counted text is real text: long enough, hardly any control or replacement characters, mostly printable or some Han."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return (F.col("non_ws") >= least) & (ratio("control", "chars") <= 0.02) & (ratio("replacement", "chars") <= 0.005) & ((ratio("printable", "non_ws") >= 0.85) | (ratio("cjk", "non_ws") >= 0.12))


def document_usable(pages: str, pages_with_text: str, least: int = 200) -> Column:
    """Whether a whole text layer can be used: as a page, and not a scan with a few printed pages in it."""
    p, w = F.col(pages), F.col(pages_with_text)
    return usable(least) & ~((F.when(p > 0, w / p).otherwise(0.0) < 0.5) & (p - w >= 2))


def route(df: DataFrame, has_tables: Column | None = None) -> DataFrame:
    """Counted pages with ``mode`` (text or ocr) and ``reason``; tables count only on usable pages."""
    tables = F.coalesce(has_tables, F.lit(False)) if has_tables is not None else F.lit(False)
    ok = usable()
    return df.withColumn("mode", F.when(ok & ~tables, "text").otherwise("ocr")).withColumn("reason", F.when(~ok, "no-usable-text").when(tables, "table-present").otherwise("native-text"))


def routing_summary(routed: DataFrame, key: str) -> DataFrame:
    return routed.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("mode") == "text").alias("text_pages"), F.count_if(F.col("mode") == "ocr").alias("ocr_pages"), F.count_if(F.col("reason") == "table-present").alias("table_pages"))


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sections (key, section, level, title, body) of marked-down text; what stands before the first heading is dropped."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("pos", "line"))
    heading = rf"^(#{{1,6}}){WS}+(.+?){WS}*$"
    w = Window.partitionBy(key).orderBy("pos")
    marked = lines.withColumn("is_head", F.col("line").rlike(heading)).withColumn("section", F.sum(F.col("is_head").cast("int")).over(w)).where("section > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_head"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    head = F.max(F.when(F.col("is_head"), F.col("line")))
    out = marked.groupBy(key, "section").agg(head.alias("head"), body.alias("body"))
    return out.select(key, "section", F.length(F.regexp_extract("head", heading, 1)).alias("level"), F.regexp_extract("head", heading, 2).alias("title"), F.regexp_replace("body", f"^{WS}+|{WS}+$", "").alias("body"))


def guess_title(c: Column | str) -> Column:
    """The first line with 4 to 80 characters once marks and blanks are stripped; null for none."""
    c = F.col(c) if isinstance(c, str) else c
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, "^[ #\t]+|[ #\t]+$", ""))
    return F.try_element_at(F.filter(lines, lambda x: F.length(x).between(4, 80)), F.lit(1))


def find_pages(fragments: DataFrame, blocks: DataFrame, key: str, least: int = 8, window: int = 12) -> DataFrame:
    """The page on which each fragment (key, frag_id, fragment) stands in its document's blocks (key, block_pos, page, text).

    Windows of 12 characters are tried in order, and for each the blocks in order.  Blocks of documents without a
    fragment are left out first; a document's blocks meet its fragments as one array, searched inside the JVM."""
    frags = fragments.select(key, "frag_id", ws_free("fragment").alias("_f")).where(F.length("_f") >= least)
    asked = blocks.join(frags.select(key).distinct(), key, "left_semi")
    text = asked.select(key, "block_pos", "page", ws_free("text").alias("_t")).where(F.length("_t") >= least)
    held = text.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block_pos", "page", "_t"))).alias("_blocks"))
    places = F.sequence(F.lit(1), F.length("_f") - least + 1)

    def hits(i):
        sub = F.substr("_f", i, F.lit(window))
        return F.transform(F.filter("_blocks", lambda b: F.contains(b["_t"], sub)), lambda b: F.struct(i.alias("w"), b["block_pos"].alias("b"), b["page"].alias("page")))

    found = frags.join(held, key).select(key, "frag_id", F.array_min(F.flatten(F.transform(places, hits))).alias("_m")).where("_m is not null")
    return found.groupBy(key, "frag_id").agg(F.min("_m").alias("_m")).select(key, "frag_id", F.col("_m.page").alias("page"))


# An item of evidence names a page, then after a plus sign what stands there; items end at a semicolon.
ITEM_END, PAGE_ITEM = "(?<=[；;])", "第\\s*[0-9]+\\s*页\\s*[+＋]\\s*"


def correct_pages(evidence: DataFrame, blocks: DataFrame, key: str, id: str, text: str) -> DataFrame:
    """``evidence`` (key, id, text) with each item's page replaced by the one its fragment stands on in the blocks.

    Items are split, their fragments looked up by ``find_pages`` and joined again.  Items without a page mark, fragments
    under 8 characters and fragments found nowhere stay as they are; a null text stays null."""
    items = evidence.select(key, id, F.posexplode(F.split(text, ITEM_END)).alias("pos", "item"))
    marked = items.withColumn("mark", F.regexp_extract("item", PAGE_ITEM, 0)).withColumn("lead", F.expr("substring_index(item, mark, 1)"))
    marked = marked.withColumn("rest", F.when(F.col("mark") != "", F.substr("item", F.length("lead") + F.length("mark") + 1))).withColumn("frag_id", F.struct(id, "pos"))
    found = find_pages(marked.where("rest is not null").select(key, "frag_id", F.regexp_replace("rest", "[；;]$", "").alias("fragment")), blocks, key)
    both = marked.join(found, [key, "frag_id"], "left").withColumn("item", F.when(F.col("page").isNotNull(), F.concat("lead", F.lit("第"), F.col("page") + 1, F.lit("页 + "), "rest")).otherwise(F.col("item")))
    done = both.groupBy(key, id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]), "").alias("_done"))
    return evidence.join(done, [key, id], "left").select(key, id, F.coalesce("_done", text).alias(text))


def signature_pages(blocks: DataFrame, key: str, most: int = 4) -> DataFrame:
    """Up to ``most`` first pages with a word of the signature block, as an ordered array."""
    pages = blocks.where(ws_free("text").rlike(SIGNATURE_MARKERS)).groupBy(key).agg(F.array_sort(F.collect_set("page")).alias("p"))
    return pages.select(key, F.slice("p", 1, most).alias("pages"))


def select_pages(pages: DataFrame, key: str, most: int = 20) -> DataFrame:
    """Pages to look at (key, page, mode, has_tables): the cover, then table pages, then other pages for OCR, capped for each document."""
    rank = F.when(F.col("page") == 0, 0).when(F.col("has_tables"), 1).when(F.col("mode") == "ocr", 2)
    w = Window.partitionBy(key).orderBy("rank", "page")
    return pages.withColumn("rank", rank).where("rank is not null").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select(key, "page", "rank", "n")


def scale_boxes(items: DataFrame, dims: DataFrame, key: str) -> DataFrame:
    """Boxes in thousandths of the page to points; pages without a known size count as A4; text with a level is a title."""
    both = items.join(dims.select(key, "page", "width", "height"), [key, "page"], "left")
    width, height = F.coalesce("width", F.lit(595.0)), F.coalesce("height", F.lit(841.0))
    kinds = F.create_map(*(F.lit(x) for pair in BLOCK_TYPES.items() for x in pair))
    kind = F.when((F.col("type") == "text") & (F.coalesce("text_level", F.lit(0)) >= 1), "title").otherwise(F.coalesce(F.try_element_at(kinds, F.col("type")), F.lit("other")))
    box = [(F.get("bbox", F.lit(i)) * side / 1000.0).alias(n) for i, (n, side) in enumerate((("x0", width), ("y0", height), ("x1", width), ("y1", height)))]
    return both.where(F.size("bbox") == 4).select(key, "page", "pos", kind.alias("block_type"), *box)


def merge_pages(routes: DataFrame, ocr: DataFrame, native: DataFrame, key: str) -> DataFrame:
    """The text of each document in page order, from OCR where there is any, else from the native layer, else a mark."""
    both = routes.join(ocr.select(key, "page", F.col("text").alias("o")), [key, "page"], "left").join(native.select(key, "page", F.col("text").alias("n")), [key, "page"], "left")
    text = F.when(F.col("mode") == "text", F.coalesce("n", "o")).otherwise(F.coalesce("o", "n"))
    page = F.struct("page", F.coalesce(text, F.concat(F.lit("[page "), F.col("page") + 1, F.lit(" missing]"))).alias("t"))
    return both.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(page)), lambda x: x["t"]), "\n\n").alias("text"))
