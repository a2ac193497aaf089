"""The extract pipeline: score, tag, find duplicates, merge versions, filter, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.operators import dedup, scoring, simhash, tagging, tfidf, versions
from sedimenta.session import cut


def duplicates_tfidf(df: DataFrame, key: str, text: str, threshold: float = tfidf.THRESHOLD, texts: DataFrame | None = None) -> DataFrame:
    """Adds ``status`` and ``similar_to``; ``df`` has ``score``, ``texts`` the texts if ``df`` has not.

    Equal texts stand for each other: all but the first are its duplicates. At a threshold of 0 or less every document is
    like every other, so the first with the greatest score stays alone.
    """
    if threshold <= 0:
        best = df.agg(F.max_by(key, F.struct(F.coalesce("score", F.lit(0)), -F.col(key))).alias("__best"))
        joined = df.join(F.broadcast(best)).withColumn("similar_to", F.when(F.col("__best") != F.col(key), F.col("__best")))
        return joined.withColumn("status", F.when(F.col("similar_to").isNull(), "kept").otherwise("duplicate")).drop("__best")
    texts = df if texts is None else texts
    return dedup.deduplicate(df, key, tfidf.copies(texts, key, text), tfidf.similar_pairs(texts, key, text, threshold))


def duplicates_simhash(df: DataFrame, key: str, text: str, max_hamming: int = simhash.MAX_HAMMING, texts: DataFrame | None = None) -> DataFrame:
    """As ``duplicates_tfidf`` by fingerprints; documents of equal fingerprint stand for each other."""
    prints = cut(simhash.fingerprints(df if texts is None else texts, key, text))
    same = prints.join(simhash.classes(prints, key).select("fingerprint", "rep_id"), "fingerprint").select(key, "rep_id")
    return dedup.deduplicate(df, key, same, simhash.similar_pairs(prints, key, max_hamming))


def extract(df: DataFrame, key: str, content: str, title: str | None = None, path: str | None = None, modified: str | None = None, as_of: Column | None = None,
            threshold: float = tfidf.THRESHOLD, use_simhash: bool = False, merge: bool = False, min_score: int = 30) -> DataFrame:
    """All rows with ``score, score_detail, tags, status`` (kept, duplicate, merged, low_score), ``similar_to, merged_into``.

    The score filter comes after duplicates and versions, so a low score still competes.
    """
    scored = scoring.score(df, content, F.col(modified) if modified else None, as_of, min_score)
    scored = cut(tagging.tag(scored, content, title).select(key, "score", "score_detail", "tags"))  # without the texts
    found = duplicates_simhash(scored, key, content, texts=df) if use_simhash else duplicates_tfidf(scored, key, content, threshold, df)
    rest = df.drop("score", "score_detail", "tags", "similar_to", "status", "merged_into")
    if merge and path:
        found = cut(found)
        merged = versions.merge(rest.join(found.filter("status = 'kept'"), key), key, path, content, modified).select(key, "merged_into")
        found = found.join(merged, key, "left")
    else:
        kind = df.select(key).schema[0].dataType
        found = found.withColumn("merged_into", F.lit(None).cast(kind))
    found = rest.join(found, key)
    low = (F.col("status") == "kept") & (F.col("score") < min_score)
    return found.withColumn("status", F.when(F.col("merged_into").isNotNull(), "merged").when(low, "low_score").otherwise(F.col("status")))


def counters(extracted: DataFrame) -> DataFrame:
    """``status, documents`` of an extract run."""
    return extracted.groupBy("status").agg(F.count("*").alias("documents"))


def changed(source: DataFrame, target: DataFrame, path: str, modified: str) -> DataFrame:
    """Rows of ``source`` that are new or newer than what ``target`` holds under the same path; an unknown time is taken again."""
    seen = target.groupBy(path).agg(F.max(modified).alias("__seen"))
    return source.join(seen, path, "left").filter(F.col("__seen").isNull() | F.col(modified).isNull() | (F.col(modified) > F.col("__seen"))).drop("__seen")
