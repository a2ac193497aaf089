"""The value score of a document and the minimum-score filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import text as T


def score(df: DataFrame, text: str, modified: Column | None = None, as_of: Column | None = None, min_score: int = T.MIN_SCORE) -> DataFrame:
    """Adds ``score INT`` and ``score_detail`` (five factors, ``passed``).

    Without ``modified`` and ``as_of`` the freshness is that of an unknown time. A null text scores as an empty one.
    Columns of these names are replaced.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    fresh = T.number(50) if modified is None or as_of is None else T.freshness_score(modified, as_of)
    with_entropy = df.withColumn("__entropy", T.char_entropy(content))
    factors = {
        "length": T.length_score(content),
        "structure": T.structure_score(content),
        "freshness": fresh,
        "keywords": T.keyword_score(content),
        "uniqueness": T.uniqueness_score(F.col("__entropy"), content),
    }
    scored = with_entropy.withColumn("__f", F.struct(*(c.alias(n) for n, c in factors.items())))
    total = F.lit(0.0)
    for name in factors:
        total = total + F.col("__f")[name] * T.number(T.WEIGHTS[name])
    scored = scored.withColumn("score", total.cast("int"))
    detail = F.struct(*(F.col("__f")[n].alias(n) for n in factors), (F.col("score") >= min_score).alias("passed"))
    return scored.withColumn("score_detail", detail).drop("__entropy", "__f")


def passing(df: DataFrame, min_score: int = T.MIN_SCORE) -> DataFrame:
    """Rows with at least the minimum score; a null score counts as 0."""
    return df.filter(F.coalesce("score", F.lit(0)) >= min_score)
