"""Tags of a document from synonyms in its title and words, and from patterns in its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.text import HAN

# Words and the tags they stand for.
SYNONYMS = {
    "架构": "architecture", "architecture": "architecture", "design": "design", "设计": "design", "algorithm": "algorithm", "算法": "algorithm",
    "api": "api", "接口": "api", "system": "system", "系统": "system", "database": "database", "数据库": "database", "测试": "testing", "test": "testing",
    "report": "report", "报告": "report", "分析": "analysis", "analysis": "analysis", "plan": "planning", "计划": "planning", "方案": "solution",
    "总结": "summary", "summary": "summary", "prd": "product", "产品": "product", "需求": "requirements", "requirement": "requirements",
    "user": "user_experience", "用户": "user_experience", "体验": "user_experience", "文档": "documentation", "doc": "documentation", "manual": "documentation",
    "指南": "guide", "guide": "guide", "tutorial": "tutorial", "教程": "tutorial",
}
# Patterns in the raw text and their tags.
PATTERNS = [
    ("[Dd]ocker|[Cc]ontainer", "devops"),
    ("[Kk]ubernetes|[Kk]8s", "devops"),
    ("[Cc]loud|[Aa]ws|[Aa]zure", "cloud"),
    ("[Pp]ython", "python"),
    ("[Jj]ava", "java"),
    ("[Jj]ava[Ss]cript|[Tt]ype[Ss]cript|[Rr]eact|[Vv]ue", "frontend"),
    ("[Mm]achine [Ll]earning|[Aa]rtificial [Ii]ntelligence|[Aa]I", "ai_ml"),
    ("[Ss]ecurity|[Cc]ryptography", "security"),
    ("[Pp]erformance|[Oo]ptimiz", "performance"),
    ("[Dd]ata|[Aa]nalytic", "data"),
    ("[Mm]icroservice|[Dd]istributed", "distributed_systems"),
    ("[Ff]inance|[Ff]inancial", "finance"),
    ("[Mm]arket|[Cc]ompetitor", "business"),
]
TITLE_POINTS, PATTERN_CAP, MAX_TAGS = 3, 5, 5


def tag_scores(text: Column, title: Column) -> Column:
    """Array of (tag, points, first) of one document; ``first`` ranks tags by where they were met first.

    Title words count 3 each, words of the text 1, patterns up to 5; title words come first, then words by their
    first place, then patterns in their order. Nulls count as empty.
    """
    synonyms = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    title_words = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(f"[{HAN}]+|[a-z]+"), F.lit(0))
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[{HAN}]{{2,}}|[a-z]{{2,}}"), F.lit(0))
    raw = F.coalesce(text, F.lit(""))
    hits = lambda array, points, base: F.filter(
        F.transform(array, lambda w, i: F.struct(synonyms[w].alias("tag"), F.lit(points).alias("points"), (F.lit(base) + i).cast("long").alias("first"))), lambda h: h["tag"].isNotNull()
    )
    found = [F.struct(F.lit(tag).alias("tag"), F.least(F.regexp_count(raw, F.lit(p)), F.lit(PATTERN_CAP)).alias("points"), F.lit((1 << 41) + i).cast("long").alias("first")) for i, (p, tag) in enumerate(PATTERNS)]
    patterns = F.filter(F.array(*found), lambda h: h["points"] > 0)
    return F.concat(hits(title_words, TITLE_POINTS, 0), hits(words, 1, 1 << 40), patterns)


def tag(df: DataFrame, text: str, title: str | None = None, max_tags: int = MAX_TAGS) -> DataFrame:
    """Adds ``tags``: the best ``max_tags`` by points, ties by first place. Narrow: a document's hits are folded in its row.

    The set of tags is fixed, so what is folded per document is bounded whatever its length.
    """
    tags = sorted({*SYNONYMS.values(), *(t for _, t in PATTERNS)})
    heading = F.col(title) if title else F.lit("")
    scored = df.withColumn("__hits", tag_scores(F.col(text), heading))

    def total(name: str) -> Column:
        own = F.filter("__hits", lambda h: h["tag"] == name)
        points = -F.aggregate(own, F.lit(0), lambda a, h: a + h["points"])
        return F.struct(points.alias("points"), F.array_min(F.transform(own, lambda h: h["first"])).alias("first"), F.lit(name).alias("tag"))

    ranked = F.array_sort(F.filter(F.array(*map(total, tags)), lambda s: s["points"] < 0))
    none = F.array().cast("array<string>")
    best = F.transform(F.slice(ranked, 1, max_tags), lambda s: s["tag"]) if max_tags > 0 else none
    hit = F.size("__hits") > 0
    return scored.withColumn("tags", F.when(hit, best).otherwise(none)).drop("__hits")
