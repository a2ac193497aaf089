"""Problem 4: new batches deduplicated against all history with a persisted prefix-tree hash forest.

The index keeps, for every accepted record, its sketch and its labels in several sorted trees, and for every record
seen, the key of its shingle set. A batch is signed once; the entries that share a label prefix with one of its own are
located tree by tree (``neardup.candidates``: entries sorted by prefix, prefixes as long as the recall target allows) and
verified on their texts. Texts of history are read only for candidates and never signed again. Each batch adds a run
of its own; runs are merged when there are many.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import neardup
from sedimenta.session import cut, release, shared_dir

#: Runs that an index holds before they are merged into one.
RUNS = 8
#: Turns that the trees take, so that a part of the entries of batch and history lies on disk at a time; results are equal.
PASSES = 3
#: Rows that are taken together, as a multiple of the rows before them.
GROWTH = 2


@dataclass
class Forest:
    """An index in the shared folder: Parquet runs of accepted entries and of keys seen."""

    spark: SparkSession
    width: int
    threshold: float
    path: str = ""
    runs: list[str] = field(default_factory=list)
    seen: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.path = self.path or f"{shared_dir(self.spark)}/forest-{uuid.uuid4().hex}"

    def _write(self, df: DataFrame, kind: str) -> str:
        target = f"{self.path}/{kind}-{uuid.uuid4().hex}"
        df.write.parquet(target)
        return target

    def _merge(self) -> None:
        if len(self.runs) > RUNS:
            self.runs = [self._write(self.spark.read.parquet(*self.runs), "run")]
            self.seen = [self._write(self.spark.read.parquet(*self.seen), "seen")]

    def _fresh(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The signed records of the batch whose shingle set no record before has, and the ids of the others."""
        signed = cut(neardup.sign(batch.withColumn("g", F.lit(0)), ["g", "id", "arrival"], F.col("text"), self.width))
        repeats = neardup.repeated(signed, "g", ["arrival", "id"]).select("id")
        if self.runs:
            seen = self.spark.read.parquet(*self.seen)
            repeats = repeats.unionByName(signed.select("id", "same").join(seen, "same", "left_semi").select("id")).distinct()
        repeats = cut(repeats)
        return cut(signed.join(repeats, "id", "left_anti")), repeats

    def accept(self, batch: DataFrame, texts: DataFrame) -> DataFrame:
        """The ids of the batch's records that repeat a record accepted before; the others enter the index.

        ``batch`` has ``id, arrival, text``; records come in order of ``arrival``, then ``id``. ``texts`` has ``id, text``
        of the batch and of all history. A record without a shingle is similar to none and leaves no entry.
        """
        release(self.spark)  # what the batch before left behind
        fresh, repeats = self._fresh(batch)
        release(self.spark)
        known = fresh.withColumn("fresh", F.lit(True))
        if self.runs:
            known = known.unionByName(self.spark.read.parquet(*self.runs).withColumn("fresh", F.lit(False)))
        pairs = cut(neardup.candidates(known, "g", "id", self.threshold, "fresh", PASSES))
        release(self.spark)
        links = neardup.verify(pairs, texts.withColumn("g", F.lit(0)), "g", self.width, self.threshold)
        places = known.select("id", "arrival", "fresh")
        links = links.select("id_a", "id_b").join(places.toDF("id_a", "arrival_a", "fresh_a"), "id_a").join(places.toDF("id_b", "arrival_b", "fresh_b"), "id_b")
        before = F.struct("arrival_a", "id_a") < F.struct("arrival_b", "id_b")
        before = F.when(F.col("fresh_a") == F.col("fresh_b"), before).otherwise(~F.col("fresh_a"))
        side = lambda a, b: F.when(before, F.col(a)).otherwise(F.col(b))
        edges = cut(links.select(side("id_a", "id_b").alias("earlier"), side("id_b", "id_a").alias("later"), (side("fresh_a", "fresh_b") == F.lit(False)).alias("settled")))
        release(self.spark)
        refused = cut(_refused(edges))
        accepted = fresh.join(refused, "id", "left_anti")
        self.runs.append(self._write(accepted, "run"))
        self.seen.append(self._write(fresh.select("same"), "seen"))
        self._merge()
        release(self.spark)
        return repeats.unionByName(refused)


def _refused(edges: DataFrame) -> DataFrame:
    """Records linked to an accepted earlier record; ``settled`` edges start at a record accepted in an earlier batch.

    A record is accepted as soon as no earlier record that may still be accepted is linked to it. Each round settles at
    least the first open record of every connected part, in practice nearly all of it.
    """
    refused = edges.filter("settled").select(F.col("later").alias("id")).distinct()
    open_edges = cut(_without(edges.filter("NOT settled").select("earlier", "later"), refused))
    while not open_edges.isEmpty():
        heads = open_edges.join(open_edges.select(F.col("later").alias("earlier")), "earlier", "left_anti")
        new = cut(heads.select(F.col("later").alias("id")).distinct())
        refused = refused.unionByName(new)
        open_edges = cut(_without(open_edges, new))
    return refused


def _without(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges of which neither end is among ``ids``."""
    for end in ("earlier", "later"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_anti")
    return edges


def rounds(counts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of batch numbers to take together: each at most GROWTH times all history before it, so that the index is read a
    number of times that grows as the logarithm of the rows, whatever the number of batches. ``counts``: (batch, rows)."""
    out: list[tuple[int, int]] = []
    done = open_rows = 0
    for number, rows in sorted(counts):
        if out and done and open_rows + rows <= GROWTH * done:
            out[-1] = (out[-1][0], number)
            open_rows += rows
            continue
        done += open_rows
        out.append((number, number))
        open_rows = rows
    return out
