"""Column expressions on the front matter that may open a Markdown file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What stands between a first line ``---`` and the next line ``---``, both included.
BLOCK = r"(?s)\A---[ \t]*\r?\n(?:.*?\n)??---[ \t]*\r?(?:\n|\z)"


def body(content: Column) -> Column:
    """What follows the front matter, or the whole content if there is none; null for null."""
    return F.when(content.startswith("---"), F.regexp_replace(content, BLOCK, "")).otherwise(content)


#: What a front matter needs to be parsed: it opens the text and is closed by a line of its own.
STRICT = r"(?s)\A---\n(.*?)\n---\n"


def matter(content: Column) -> Column:
    """The text between the marks, empty if there is none."""
    return F.regexp_extract(content, STRICT, 1)


def field(content: Column, name: str) -> Column:
    """A quoted value of the front matter, null if it has none."""
    return F.nullif(F.regexp_extract(matter(content), rf'(?md)^{name}: "(.*)"$', 1), F.lit(""))


def parse(content: Column, path: Column) -> Column:
    """Struct ``title, tags, body``: title from the front matter or the file's stem, tags from ``dk_tags``, body stripped."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    inside = F.regexp_extract(matter(content), r"(?md)^dk_tags: \[(.*)\]", 1)
    items = F.transform(F.split(inside, ","), lambda t: F.regexp_replace(F.trim(t), '^"+|"+$', ""))
    tags = F.filter(items, lambda t: t != "")
    rest = F.regexp_replace(F.regexp_replace(content, STRICT, ""), r"(?U)\A\s+|\s+\z", "")
    return F.struct(F.coalesce(field(content, "title"), stem).alias("title"), tags.alias("tags"), rest.alias("body"))


def render(title: Column, source: Column, relative: Column, original_format: Column, status: Column, converted_at: Column, size: Column, extra: dict[str, Column] | None = None) -> Column:
    """Front matter of a converted file; ``relative`` and ``size`` only if not empty, ``extra`` before the end mark.

    A skipped file gets a note and a link after it, a failed one a note. A null value drops its line.
    """
    quoted = lambda name, value: F.concat(F.lit(f'{name}: "'), value, F.lit('"'))
    present = lambda name, value: F.when(value != "", quoted(name, value))
    url = F.concat(F.lit("file:///"), source)
    skipped = F.concat(
        F.lit("# "), title, F.lit("\n\n> ⚠️ 此文件类型为 `."), original_format, F.lit("`，暂不支持转换。\n> [打开源文件]("), url, F.lit(")")
    )
    note = F.when(status == "skipped", skipped).when(status == "error", F.concat(F.lit("# "), title, F.lit("\n\n> ❌ 转换失败。"))).otherwise("")
    return F.concat_ws(
        "\n",
        F.lit("---"),
        quoted("title", title),
        quoted("source", url),
        present("source_relative", relative),
        quoted("converted_at", converted_at),
        quoted("original_format", original_format),
        quoted("conversion_status", status),
        present("file_size", size),
        *(quoted(name, value) for name, value in (extra or {}).items()),
        F.lit("---"),
        note,
    )


@F.pandas_udf(StringType())
def one_decimal(values: pd.Series) -> pd.Series:
    """A number as text, rounded to one decimal on its binary value."""
    return values.map(lambda v: None if pd.isna(v) else str(round(float(v), 1)), na_action=None)


def with_scores(content: Column, score: Column, detail: Column, tags: Column) -> Column:
    """The content with score, factors and tags at the end of its front matter, which is made if there is none."""
    quoted = F.array_join(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", ")
    factors = [F.concat(F.lit(f"  {name}: "), one_decimal(detail[name])) for name in ("length", "structure", "freshness", "keywords", "uniqueness")]
    lines = F.concat_ws("\n", F.lit(""), F.concat(F.lit("dk_score: "), score.cast("string")), F.lit("dk_score_detail:"), *factors, F.concat(F.lit("dk_tags: ["), quoted, F.lit("]")), F.lit(""))
    has = content.rlike(STRICT)
    rest = F.regexp_replace(content, STRICT, "")
    return F.when(has, F.concat(F.lit("---\n"), matter(content), lines, F.lit("---\n\n"), rest)).otherwise(F.concat(F.lit("---\n"), lines, F.lit("---\n\n"), content))


def for_vault(content: Column, path: Column, today: Column, exact_keys: bool = True) -> Column:
    """The content with the ``tags`` and ``created`` keys that a note vault asks for, each only where it is missing.

    ``exact_keys`` looks for the keys at line starts; otherwise any mention of ``tags:`` counts, ``dk_tags:`` too.
    """
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    inside = matter(content)
    has = lambda key: inside.rlike(rf"(?m)^{key}:") if exact_keys else inside.contains(f"{key}:")
    more = F.concat(
        F.when(has("tags"), "").otherwise("\ntags: []"), F.when(has("created"), "").otherwise(F.concat(F.lit('\ncreated: "'), today, F.lit('"')))
    )
    new = F.concat(F.lit('---\ntitle: "'), stem, F.lit('"\ncreated: "'), today, F.lit('"\ntags: []\n---\n\n'), content)
    return F.when(content.rlike(STRICT), F.concat(F.lit("---\n"), inside, more, F.lit("\n---\n\n"), F.regexp_replace(content, STRICT, ""))).otherwise(new)
