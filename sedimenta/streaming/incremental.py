"""Structured Streaming forms: documents scored and tagged as they arrive, fingerprints checked against what was kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sedimenta.operators import scoring, simhash, tagging


def scored(stream: DataFrame, text: str, title: str | None = None) -> DataFrame:
    """Stateless scoring and tagging; the same columns as in batch."""
    return tagging.tag(scoring.score(stream, text), text, title)


def windowed_counts(stream: DataFrame, time: str, kind: str, value: str, width: str, late: str) -> DataFrame:
    """Counts and sums by tumbling window and kind; rows later than the watermark are dropped."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, width), kind)
    return grouped.agg(F.count("*").alias("rows"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "rows", "total")


def keep_new(spark: SparkSession, stream: DataFrame, key: str, text: str, target: str, checkpoint: str, max_hamming: int = simhash.MAX_HAMMING) -> StreamingQuery:
    """Appends to the Parquet folder ``target`` what is not within the distance of anything kept; one batch at a time.

    Batches are named by their number and written to a folder of their own, so a batch that is repeated after a failure
    replaces itself. Within a batch the smallest key of a group survives.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark_ = rows.sparkSession
        prints = simhash.fingerprints(rows, key, text)
        reps = simhash.classes(prints, key).select(F.col("rep_id").alias(key), "fingerprint")
        fresh = reps
        earlier = _kept(spark_, target, number)
        if earlier is not None:
            a = simhash.bands(reps, key, max_hamming)
            b = simhash.bands(earlier, key, max_hamming).select("band", "band_key", F.col("fingerprint").alias("other"))
            near = a.join(b, ["band", "band_key"]).filter(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))) <= max_hamming)
            fresh = reps.join(near.select(key).distinct(), key, "left_anti")
        inside = simhash.similar_pairs(fresh, key, max_hamming).select(F.col("id_b").alias(key)).distinct()
        fresh.join(inside, key, "left_anti").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _kept(spark: SparkSession, target: str, before: int) -> DataFrame | None:
    """What earlier batches kept, or None before the first."""
    from pyspark.errors import AnalysisException

    try:
        kept = spark.read.parquet(target)
    except AnalysisException:
        return None
    return kept.filter(F.col("batch") < before).drop("batch")
