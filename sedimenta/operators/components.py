"""Connected components by propagation of the smallest id, with shortcuts over representatives."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.session import cut

#: Edges up to which one task finds the components; a bound on its memory, the result is the same.
FEW = 500_000


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every id in ``edges`` (``id_a, id_b``); a component is its smallest id.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing changes: a number of rounds that grows
    as the square of the logarithm of the size, each a pair of aggregations; no component is gathered. Few edges are
    joined by one task of an executor instead.
    """
    both = edges.select(F.least("id_a", "id_b").alias("low"), F.greatest("id_a", "id_b").alias("high")).filter("low != high").distinct()
    current = cut(both)
    if current.count() <= FEW:
        return _joined(current)
    state = None
    while True:
        around = current.select(F.explode(F.array(F.struct(F.col("low").alias("u"), F.col("high").alias("v")), F.struct(F.col("high").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.*")
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.filter("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high")).distinct()
        smallest = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(smallest, "high").select(F.explode(F.array(F.struct(F.col("m").alias("low"), F.col("high").alias("high")), F.struct(F.col("m").alias("low"), F.col("low").alias("high")))).alias("e")).select("e.*").filter("low != high").distinct()
        current = cut(small)
        before, state = state, current.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(20,0)"))).first()
        if state == before:
            break
    heads = current.select(F.col("low").alias("id"), F.col("low").alias("component")).distinct()
    return current.select(F.col("high").alias("id"), F.col("low").alias("component")).unionByName(heads)


def _joined(edges: DataFrame) -> DataFrame:
    """The components of few edges, by union and find in one task."""
    kind = edges.schema["low"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for low, high in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(parent.setdefault(low, low)), root(parent.setdefault(high, high))
                parent[max(a, b)] = min(a, b)
        if parent:
            ids = list(parent)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([root(x) for x in ids])], ["id", "component"])

    return edges.coalesce(1).mapInArrow(run, f"id {kind}, component {kind}")
