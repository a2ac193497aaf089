"""Column expressions on slide texts: anchors, recognised pages and layout notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANCHOR = r"<!-- Slide number: (\d+) -->"
FAILED = ("[图片识别失败", "[图片解析失败")
FRIENDLY = "⚠️ 本页图表语义识别失败（VLM 请求异常），原始文字已保留"
_OLD_FAILURE = r"⚠️ 本页图表语义识别失败（VLM 请求异常），原始文字已保留|> 📊 \*\*整页理解\*\*: (?:⚠️|\[[^\r\n]*\])"


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def failed(said: Column) -> Column:
    """Whether a recognised text is a failure mark."""
    return said.startswith(FAILED[0]) | said.startswith(FAILED[1])


def page_ok(said: Column) -> Column:
    """Whether a page was recognised: not null, not blank and no failure mark."""
    return F.coalesce((strip(said) != "") & ~failed(said), F.lit(False))


def description(said: Column) -> Column:
    """A failure mark as a readable note, anything else as it is."""
    return F.when(failed(said), F.lit(FRIENDLY)).otherwise(said)


def parse_page(said: Column) -> Column:
    """Struct ``title, overview, structure, body`` of a tagged page text; null for a failure or a missing or blank body."""

    def block(tag: str) -> Column:
        pattern = rf"(?s)\[DK-{tag}\](.*?)(?=\[DK-|\z)"
        return F.when(said.rlike(pattern), strip(F.regexp_extract(said, pattern, 1)))

    whole = strip(F.regexp_extract(said, r"(?s)\[DK-正文\](.*)\z", 1))
    fields = F.struct(block("标题").alias("title"), block("概述").alias("overview"), block("结构").alias("structure"), whole.alias("body"))
    return F.when(page_ok(said) & (whole != ""), fields)


def render_page(page_text: Column, parsed: Column) -> Column:
    """Title with structure, overview, body and the folded original text, apart by blank lines; empty parts fall out."""
    some = lambda name: F.nullif(strip(F.coalesce(parsed[name], F.lit(""))), F.lit(""))
    title = F.concat(F.lit("📊 **"), some("title"), F.lit("**"), F.coalesce(F.concat(F.lit("（"), some("structure"), F.lit("）")), F.lit("")))
    original = F.nullif(strip(page_text), F.lit(""))
    folded = F.concat(F.lit("<details><summary>markitdown 原文（兜底参考）</summary>\n"), original, F.lit("\n</details>"))
    return F.concat_ws("\n\n", title, F.concat(F.lit("**概述**："), some("overview")), some("body"), folded)


def _pages(text: Column, change) -> Column:
    parts = F.split(text, r"(?=<!-- Slide number: \d+ -->)")

    def one(part: Column) -> Column:
        number = F.regexp_extract(part, rf"\A{ANCHOR}", 1)
        page = F.substring(part, F.length(F.regexp_extract(part, rf"\A{ANCHOR}", 0)) + 1, F.length(part))
        return F.when(number == "", part).otherwise(change(part, number.try_cast("int"), page))

    return F.regexp_replace(F.array_join(F.transform(parts, one), "\n"), r"\A\n+", "")


def _anchor(number: Column) -> Column:
    return F.concat(F.lit("<!-- Slide number: "), number.cast("string"), F.lit(" -->\n\n"))


def inject_pages(text: Column, said: Column) -> Column:
    """Each page with a result (map of page to text) is rendered if it parses, else quoted below; others stay."""

    def change(part: Column, number: Column, page: Column) -> Column:
        result = F.coalesce(said[number], F.lit(""))
        parsed = parse_page(result)
        quote = F.concat(F.regexp_replace(part, r"(?U)\s+\z", ""), F.lit("\n\n> 📊 **整页理解**: "), description(result))
        return F.when(result == "", part).when(parsed.isNotNull(), F.concat(_anchor(number), render_page(page, parsed))).otherwise(quote)

    return F.when(F.size(said) > 0, _pages(text, change)).otherwise(text)


def update_pages(text: Column, said: Column) -> Column:
    """As ``inject_pages`` for the pages that have a result, after their old failure notes were taken out."""

    def change(part: Column, number: Column, page: Column) -> Column:
        result = said[number]
        bare = F.regexp_replace(page, _OLD_FAILURE, "")
        parsed = parse_page(result)
        still = F.concat(_anchor(number), description(result), F.lit("\n\n"), strip(bare))
        return F.when(~F.map_contains_key(said, number), part).when(parsed.isNotNull(), F.concat(_anchor(number), render_page(bare, parsed))).otherwise(still)

    return F.when(F.size(said) > 0, _pages(text, change)).otherwise(text)


def inject_layout(text: Column, layouts: Column) -> Column:
    """Below each anchor whose page has layout notes (map of page to array), a quote that lists them."""
    parts = F.split(text, r"(?=<!-- Slide number: \d+ -->)")

    def one(part: Column) -> Column:
        head = F.regexp_extract(part, rf"\A{ANCHOR}", 0)
        items = layouts[F.regexp_extract(part, rf"\A{ANCHOR}", 1).try_cast("int")]
        rest = F.substring(part, F.length(head) + 1, F.length(part))
        return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.concat(head, F.lit("\n> 🗂 **版式**: "), F.array_join(items, " · "), rest)).otherwise(part)

    return F.array_join(F.transform(parts, one), "")


def failed_pages(text: Column) -> Column:
    """Sorted distinct numbers of the pages that are followed by a failure note."""
    pattern = rf"(?s){ANCHOR}(?:(?!<!-- Slide number).)*?(?:{_OLD_FAILURE})"
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: n.cast("int"))))


def source_file(text: Column) -> Column:
    """The path that a mirror file names as its source, null if none."""
    return F.nullif(F.regexp_extract(text, r'(?md)^source: "file:///(.+)"$', 1), F.lit(""))


def page_number(name: Column) -> Column:
    """The page of an image named page{N}.png, else 0."""
    return F.coalesce(F.regexp_extract(name, r"page(\d+)\.png$", 1).try_cast("int"), F.lit(0))


def shape_role(shape: Column) -> Column:
    """A slide shape's role from its facts (placeholder, chart, rows, columns, kind, text); null for mere decoration."""
    titles = ["TITLE", "CENTER_TITLE", "VERTICAL_TITLE", "SUBTITLE"]
    return (
        F.when(shape["placeholder"].isin(titles), "标题")
        .when(shape["placeholder"].isNotNull(), "占位符")
        .when(shape["chart"], "图表")
        .when(shape["rows"].isNotNull(), F.concat(F.lit("表格 "), shape["rows"].cast("string"), F.lit("×"), shape["columns"].cast("string")))
        .when(shape["kind"] == 13, "图片")
        .when(shape["kind"] == 6, "分组")
        .when(strip(F.coalesce(shape["text"], F.lit(""))) != "", "正文")
    )


def shape_region(left: Column, top: Column, width: Column, height: Column, slide_width: Column, slide_height: Column) -> Column:
    """A shape's coarse place on its slide; empty where its box is unknown."""
    is_left = left + width / 2 < slide_width * 0.5
    is_top = top + height / 2 < slide_height * 0.5
    quarter = F.when(is_top, F.when(is_left, "左上").otherwise("右上")).otherwise(F.when(is_left, "左下").otherwise("右下"))
    return (
        F.when(left.isNull() | top.isNull() | width.isNull() | height.isNull(), "")
        .when(width >= slide_width * 0.9, "整页宽")
        .when(height >= slide_height * 0.9, "整页高")
        .when((width < slide_width * 0.5) & (height < slide_height * 0.6), F.when(is_left, "左栏").otherwise("右栏"))
        .otherwise(quarter)
    )
