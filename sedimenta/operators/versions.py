"""Versions of a file merged into the best one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of a version in a file's stem, taken out in this order in any letter case.
MARKS = [r"_v(\d+)", r"[_\-]v(\d+)[\.\-_]", r"_ver(\d+)", r"_version(\d+)", r"(\d+)\.(\d+)", r"[_\-](\d{8})", r"_final", r"_latest"]


def version_key(path: Column, by_folder: bool = False) -> Column:
    """The file's name without version marks; null for null. The folder counts only if asked for."""
    name = F.element_at(F.split(path, "/"), -1)
    dotted = F.length(name) - F.length(F.substring_index(name, ".", -1)) > 1
    extension = F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise(name)
    stem = F.when(dotted & ~name.endswith("."), F.substring(name, F.lit(1), F.length(name) - F.length(extension) - 1)).otherwise(name)
    for mark in MARKS:
        stem = F.regexp_replace(stem, f"(?i){mark}", "")
    stem = F.regexp_replace(F.regexp_replace(stem, r"[_\-]{2,}", "_"), r"^[_\-]+|[_\-]+$", "")
    key = F.concat(stem, F.lit("."), extension)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(name))
    return F.concat(folder, key) if by_folder else key


def merge(df: DataFrame, key: str, path: str, content: str, modified: str | None, by_folder: bool = False) -> DataFrame:
    """Adds ``version_key``, ``merged_into`` (null for the survivor): best score, then length, then time, then first key.

    One aggregation with map-side partials finds the winners; a large group is never gathered. Nulls count as 0, empty
    and the earliest time. Rows without a path stay by themselves.
    """
    keyed = df.withColumn("version_key", version_key(F.col(path), by_folder))
    time = F.coalesce(F.unix_micros(modified), F.lit(0)) if modified else F.lit(0)
    rank = F.struct(F.coalesce("score", F.lit(0)).alias("a"), F.length(F.coalesce(content, F.lit(""))).alias("b"), time.alias("c"), (-F.col(key)).alias("d"))
    best = keyed.filter("version_key IS NOT NULL").groupBy("version_key").agg(F.max(rank).alias("r")).select("version_key", (-F.col("r.d")).alias("__best"))
    joined = keyed.join(best, "version_key", "left")
    return joined.withColumn("merged_into", F.when(F.col("__best") != F.col(key), F.col("__best"))).drop("__best")
