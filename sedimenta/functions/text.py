"""Column expressions on text: the five quality factors, tokens and term lists."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

# The terms whose density is scored, in any letter case.
KEY_TERMS = [
    "架构", "设计", "分析", "报告", "方案", "总结", "计划", "算法", "系统", "模型", "框架", "协议", "规范",
    "API", "SDK", "HTTP", "JSON", "XML", "performance", "architecture", "algorithm", "system",
]
# Weights of the five factors, the ideal length in characters and the score that passes.
WEIGHTS = {"length": 0.20, "structure": 0.25, "freshness": 0.15, "keywords": 0.20, "uniqueness": 0.20}
IDEAL_LENGTH, MIN_SCORE = 2000, 30
# The Markdown features that are scored, as patterns.
HEADING = r"(?mdU)^#{1,6}\s+.+"
LIST_ITEM = r"(?mdU)^[\s]*[-*]\s+.+"
FENCE = r"(?md)^```"
LINK = r"(?d)\[.+?\]\(.+?\)"
HAN = "一-鿿"


def number(value: float) -> Column:
    """A double literal."""
    return F.lit(float(value))


def length_score(text: Column) -> Column:
    """0 to 100 up to the ideal length, down to 50 at twice that; null counts as empty."""
    ratio = F.least(F.length(F.coalesce(text, F.lit(""))) / number(IDEAL_LENGTH), number(2))
    return F.when(ratio <= 1, ratio * 100).otherwise(number(100) - (ratio - 1) * 50)


def structure_score(text: Column) -> Column:
    """Points for headings, lists, code fences, tables and links."""
    text = F.coalesce(text, F.lit(""))
    points = lambda condition, n: F.when(condition, number(n)).otherwise(number(0))
    headings = F.regexp_count(text, F.lit(HEADING))
    pipes = F.length(text) - F.length(F.translate(text, "|", ""))
    total = (
        points(headings >= 1, 30) + points(headings >= 3, 10) + points(text.rlike(LIST_ITEM), 15)
        + points(text.rlike(FENCE), 10) + points(pipes > 4, 15) + points(text.rlike(LINK), 10)
    )
    return F.least(total, number(100))


def freshness_score(modified: Column, as_of: Column) -> Column:
    """By whole days of age: 100 for a month, then falling in three slopes; 50 where the time is unknown."""
    days = F.floor((F.unix_micros(as_of) - F.unix_micros(modified)) / number(86_400_000_000))
    return (
        F.when(modified.isNull(), number(50))
        .when(days <= 30, number(100))
        .when(days <= 180, number(100) - (days - 30) * number(0.3))
        .when(days <= 365, number(55) - (days - 180) * number(0.15))
        .otherwise(F.greatest(number(10), number(40) - (days - 365) * number(0.01)))
    )


def keyword_hits(text: Column) -> Column:
    """Occurrences of the key terms in any letter case, each term counted by itself.

    Counted by what their removal leaves out, which is several times faster than patterns. The four characters that are
    forms of i, k and s in another case count as these.
    """
    text = F.coalesce(text, F.lit(""))

    def count(both: Column) -> Column:
        total = F.lit(0)
        for term in KEY_TERMS:
            where = both["low"] if term.isascii() else both["text"]
            total = total + ((F.length(where) - F.length(F.replace(where, F.lit(term.lower())))) / len(term)).cast("int")
        return total

    both = F.struct(F.lower(F.translate(text, "ıİſK", "iisk")).alias("low"), text.alias("text"))
    return F.transform(F.array(both), count)[0]  # the lower-cased text is made once


def keyword_score(text: Column) -> Column:
    """By hits per character: rises to 100 at 0.005, stays to 0.03, then falls to 50; 0 for an empty text."""
    size = F.length(F.coalesce(text, F.lit("")))
    density = keyword_hits(text) / F.greatest(size, F.lit(1))
    return (
        F.when(size == 0, number(0))
        .when(density < number(0.005), density / number(0.005) * 100)
        .when(density <= number(0.03), number(100))
        .otherwise(F.greatest(number(50), number(100) - (density - number(0.03)) * 2000))
    )


@F.pandas_udf(DoubleType())
def char_entropy(texts: pd.Series) -> pd.Series:
    """Shannon entropy of a text's code points in bits; 0 for an empty text, null for null. Narrow: no shuffle."""

    def one(text: str | None) -> float | None:
        if not text:
            return None if text is None else 0.0
        counts = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)[1]
        p = counts / counts.sum()
        return float(-(p * np.log2(p)).sum()) + 0.0

    return texts.map(one, na_action=None).astype("float64")


def uniqueness_score(entropy: Column, text: Column) -> Column:
    """By entropy: 20 below 4 bits, 50 below 8, then up to 100; 0 for an empty text."""
    return (
        F.when(F.length(F.coalesce(text, F.lit(""))) == 0, number(0))
        .when(entropy < 4, number(20))
        .when(entropy < 8, number(50))
        .otherwise(F.least(number(100), number(70) + (entropy - 8) * number(7.5)))
    )


def similarity_terms(text: Column) -> Column:
    """ASCII words of two letters or more, lower-cased, then pairs of successive Chinese characters of the whole text."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0))
    chars = F.split(F.regexp_replace(text, f"[^{HAN}]", ""), "")
    size = F.greatest(F.size(chars) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(chars, F.lit(1), size), F.slice(chars, F.lit(2), size), lambda a, b: F.concat(a, b))
    return F.concat(words, pairs)


_ASCII_WORDS, _HAN = re.compile("[a-z]{2,}").findall, re.compile(f"[{HAN}]").findall


def count_terms(text: str | None) -> Counter:
    """The terms of ``similarity_terms`` with their counts, for use in workers."""
    text = text or ""
    han = _HAN(text)
    counts = Counter(_ASCII_WORDS(text.lower()))
    counts.update(map("".join, zip(han, han[1:])))
    return counts


_FINGERPRINT_TOKENS = re.compile(f"[{HAN}]{{2,}}|[a-zA-Z]{{2,}}").findall
_VOTES: dict[str, np.ndarray] = {}


@F.pandas_udf(LongType())
def simhash(texts: pd.Series) -> pd.Series:
    """64-bit SimHash over words and Chinese runs, by their MD5, weighted by occurrence; 0 without tokens, null counts as empty."""

    def one(text: str | None) -> int:
        votes = np.zeros(64, np.int64)
        for token, times in Counter(_FINGERPRINT_TOKENS((text or "").lower())).items():
            signs = _VOTES.get(token)
            if signs is None:
                if len(_VOTES) > 200_000:
                    _VOTES.clear()
                low = int.from_bytes(hashlib.md5(token.encode()).digest()[8:], "big")
                signs = _VOTES[token] = np.array([1 if low >> i & 1 else -1 for i in range(64)], np.int64)
            votes += signs * times
        bits = sum(1 << i for i in np.flatnonzero(votes > 0).tolist())
        return bits - (1 << 64) if bits >> 63 else bits

    return texts.map(one, na_action=None).astype("int64")
