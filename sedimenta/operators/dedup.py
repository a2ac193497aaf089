"""Greedy resolution of similar pairs in document order.

In the order of (i, j), a pair of living documents costs the one with the smaller score its life, the later one if they
tie. Pairs of different connected parts don't touch each other, so the parts are resolved side by side: each part of a
bounded size in one pass of one task, in a single job however long its chains are. Larger parts are resolved in rounds
of window functions, without ever being gathered: each round runs, for every document in order of its partners, all
pairs that no earlier pair of either end can change any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.operators.components import components
from sedimenta.session import cut

#: Pairs of a connected part up to which one task resolves it.
PART = 200_000
#: Rounds between two checkpoints of a large part.
EVERY = 2


def resolve(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """``loser, winner`` of every document that falls; ``pairs`` has ``id_a < id_b``, ``scores`` has ``id, score``.

    A null score counts as 0. Repeated pairs count once. The order of documents is that of their ids.
    """
    score = lambda s: scores.select(F.col("id").alias(f"id_{s}"), F.coalesce("score", F.lit(0)).alias(f"score_{s}"))
    edges = cut(pairs.select("id_a", "id_b").distinct())
    kind = edges.schema["id_a"].dataType.simpleString()
    if edges.isEmpty():
        return pairs.sparkSession.createDataFrame([], f"loser {kind}, winner {kind}")
    scored = edges.join(score("a"), "id_a").join(score("b"), "id_b").withColumn("better", F.col("score_b") > F.col("score_a")).select("id_a", "id_b", "better")
    parts = components(edges).withColumnRenamed("id", "id_a")
    scored = cut(scored.join(parts, "id_a"))
    large = cut(scored.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > PART).select("component"))
    some = not large.isEmpty()
    small = scored.join(large, "component", "left_anti") if some else scored
    fallen = _in_parts(small, kind)
    if some:
        fallen = fallen.unionByName(_in_rounds(scored.join(large, "component", "left_semi").drop("component"), kind))
    return fallen


def _in_parts(scored: DataFrame, kind: str) -> DataFrame:
    """Resolves whole parts: sorted by part and pair they stream through a worker, which remembers the dead of one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, dead = None, set()
        for batch in batches:
            losers, winners = [], []
            for component, a, b, better in zip(*(column.to_pylist() for column in batch.columns)):
                if component != part:
                    part, dead = component, set()
                if a in dead or b in dead:
                    continue
                loser, winner = (a, b) if better else (b, a)
                dead.add(loser)
                losers.append(loser), winners.append(winner)
            yield pa.RecordBatch.from_arrays([pa.array(losers, batch.column(1).type), pa.array(winners, batch.column(1).type)], ["loser", "winner"])

    ordered = scored.select("component", "id_a", "id_b", "better").repartition("component").sortWithinPartitions("component", "id_a", "id_b")
    return ordered.mapInArrow(run, f"loser {kind}, winner {kind}")


def _in_rounds(scored: DataFrame, kind: str) -> DataFrame:
    """Resolves pairs in rounds, until none is left."""
    left, fallen, rounds = cut(scored), None, 0
    while rounds % EVERY or not left.isEmpty():
        ends = F.explode(F.array(F.struct(F.col("id_a").alias("id"), F.col("id_a").alias("from")), F.struct(F.col("id_b").alias("id"), F.col("id_a").alias("from"))))
        first = left.select(ends.alias("e")).select("e.*").groupBy("id").agg(F.min("from").alias("first"))
        ready = left.join(first.toDF("id_a", "first_a"), "id_a").join(first.toDF("id_b", "first_b"), "id_b")
        ready = ready.withColumn("blocked", ((F.col("first_a") < F.col("id_a")) | (F.col("first_b") < F.col("id_a"))).cast("int"))
        order = Window.partitionBy("id_a").orderBy("id_b")
        until, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
        ready = ready.withColumn("held", F.sum("blocked").over(until)).withColumn("dead", F.coalesce(F.sum(F.col("better").cast("int")).over(before), F.lit(0)))
        done = ready.filter("held = 0 AND dead = 0")
        lost = F.when(F.col("better"), F.struct(F.col("id_a").alias("loser"), F.col("id_b").alias("winner"))).otherwise(F.struct(F.col("id_b").alias("loser"), F.col("id_a").alias("winner")))
        new = cut(done.select(lost.alias("x")).select("x.*"))
        fallen = new if fallen is None else fallen.unionByName(new)
        gone = new.select("loser")
        left = left.join(gone, left["id_a"] == gone["loser"], "left_anti").join(gone, left["id_b"] == gone["loser"], "left_anti")
        rounds += 1
        if rounds % EVERY == 0:
            left = cut(left)
    return fallen if fallen is not None else scored.sparkSession.createDataFrame([], f"loser {kind}, winner {kind}")


def deduplicate(df: DataFrame, key: str, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds ``status`` (kept or duplicate) and ``similar_to`` to all rows.

    ``classes`` has ``key, rep_id`` for documents that equal another one: all but the representative are duplicates of
    it. ``pairs`` relate representatives and are resolved greedily by ``score``.
    """
    named = classes.select(key, F.col("rep_id").alias("__rep"))
    scores = cut(df.select(F.col(key).alias("id"), "score"))
    fallen = resolve(pairs, scores).select(F.col("loser").alias(key), F.col("winner").alias("__winner"))
    joined = df.join(named, key, "left").join(fallen, key, "left")
    copy = F.when(F.col("__rep") != F.col(key), F.col("__rep"))
    similar = F.coalesce(copy, F.col("__winner"))
    return joined.withColumn("similar_to", similar).withColumn("status", F.when(similar.isNull(), "kept").otherwise("duplicate")).drop("__rep", "__winner")
