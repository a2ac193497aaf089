"""Problems 4 and 5: near-duplicate records across collections too large to compare pairwise.

1. ``sign``: one narrow pass turns each text into the number of its shingles, a key that equal shingle sets share, a
   sketch of 192 bits and the labels of a forest of prefix trees.
2. ``repeated``: records with equal shingle sets collapse into the first of them (map-side partials over keys, so a
   group of copies that holds a third of all rows is one row per task before the shuffle).
3. ``candidates``: representatives that share a label prefix in some tree meet in one run of a sorted partition, which
   streams through a worker. Short runs are compared at once, long ones by a signature tree (``sigtree``). Prefixes that
   a sample shows to be hot are split into pairs of blocks beforehand.
4. ``verify``: exact Jaccard similarity of the candidates' shingles.

Shuffled data per record is constant (18 trees, together or in turns); nothing is capped. Pairs of different texts are dropped by the
forest, whose recall is 0.9944 for a pair right at similarity 0.5, and by the sketch filter (fewest agreeing lanes,
also in signature trees), which keeps 0.9999 of such pairs: together 0.994 if they were independent, and more above.
There is no exact way for the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm import shingles as S
from sedimenta.llm.sigtree import AT_ONCE, SignatureTree, alike
from sedimenta.operators.components import components
from sedimenta.session import cut, parallelism, release

#: The columns of a sketch.
WORDS = [f"s{w}" for w in range(S.WORDS)]
SKETCH = ", ".join(f"{w} long" for w in WORDS)
#: Texts signed together.
TOGETHER = 256
#: The forest's recall for a pair right at the threshold; prefixes are widened until it is reached.
RECALL = 0.99
#: Ids up to which a set of ids is broadcast (16 bytes each); beyond, it is joined by a shuffle.
BROADCAST_IDS = 500_000
#: Estimated records in a run from which it is split into pairs of blocks, the size of such a block, and the share of
#: records (1 in so many) from which the estimate is made. They are the same at every size of the data, so that a run or a
#: pair of blocks fits into a task; they steer the work only, not the result.
HOT_RUN, BLOCK, ONE_IN = 20_000, 8_192, 32
#: Copies of one text that one task pairs with others when pairs are expanded; larger groups are salted.
EXPAND = 2_000
#: Runs up to this length are compared pairwise at once, longer ones by a signature tree.
SHORT_RUN = 64


def depth_for(threshold: float, trees: int = S.TREES, levels: int = S.LEVELS, recall: float = RECALL) -> int:
    """The longest label prefix whose expected recall at the threshold reaches the target; 1 if none does."""
    for depth in range(levels, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def sign(df: DataFrame, keep: list[str], text: Column, width: int) -> DataFrame:
    """``keep`` columns, ``n``, ``same`` (binary), ``s0 s1 ...``, ``labels``. Texts without a shingle, null ones too, have no row."""
    source = df.select(*keep, text.alias("text_")).filter("text_ IS NOT NULL")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = S.Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                sets = shingler.many(part.column(len(keep)).to_pylist())
                there = np.array([len(s) > 0 for s in sets], bool)
                if not there.any():
                    continue
                sets = [s for s in sets if len(s)]
                labels, sketches = S.signatures(sets)
                rows = pa.table(part.columns[: len(keep)], keep).filter(pa.array(there)).combine_chunks()
                columns = {name: rows.column(name).combine_chunks() for name in keep}
                columns["n"] = pa.array([len(s) for s in sets], pa.int32())
                columns["same"] = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
                columns |= {f"s{w}": pa.array(sketches[:, w]) for w in range(S.WORDS)}
                offsets = np.arange(0, labels.size + 1, S.TREES, dtype=np.int32)
                columns["labels"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(labels.ravel()))
                yield pa.RecordBatch.from_pydict(columns)

    return source.mapInArrow(run, f"{kept}, n int, same binary, {SKETCH}, labels array<long>")


def repeated(signed: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``group, id, rep_id`` of the records whose shingle set an earlier record has too; ``rep_id`` is the first of them.

    Only keys are shuffled, and those of a large group of copies are aggregated before; the few wide columns stay.
    """
    first = F.min(F.struct(*order)).alias("first")
    several = signed.groupBy(group, "same").agg(first, F.count("*").alias("copies")).filter("copies > 1")
    named = several.select(group, "same", F.col("first.id").alias("rep_id"))
    return signed.select(group, "same", "id").join(named, [group, "same"]).filter("id != rep_id").select(group, "id", "rep_id")


def _run(group: str, depth: int) -> Column:
    """The hash of group, ``tree`` and the prefix of ``label``."""
    prefix = F.shiftrightunsigned("label", 64 - 16 * depth)
    if depth < 4:  # few random bits, for the shuffle's sake; the group's low bits are on top
        return F.shiftleft(F.xxhash64(group), 16 * depth + 5).bitwiseOR(F.shiftleft(F.col("tree").cast("long"), 16 * depth)).bitwiseOR(prefix)
    return F.xxhash64(group, "tree", prefix)


def _hot(signed: DataFrame, group: str, key: str, depth: int) -> DataFrame | None:
    """``run, blocks`` of the runs of all trees that a sample shows to be hot; None if there is none."""
    sample = signed.filter(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(ONE_IN)) == 0)
    seen = sample.select(group, F.posexplode("labels").alias("tree", "label")).select(_run(group, depth).alias("run"))
    counts = seen.groupBy("run").agg(F.count("*").alias("c")).filter(F.col("c") >= HOT_RUN / ONE_IN)
    blocks = cut(counts.select("run", (F.floor(F.col("c") * ONE_IN / BLOCK) + 2).cast("int").alias("blocks")))
    many = blocks.count()
    if not many:
        return None
    return F.broadcast(blocks) if many <= BROADCAST_IDS else blocks


def _entries(signed: DataFrame, group: str, key: str, depth: int, extra: list[str], hot: DataFrame | None, trees: range) -> DataFrame:
    """One row for each record and tree among ``trees``, with ``run``: the hash of group, tree and label prefix; hot runs are split."""
    labels = F.slice("labels", trees.start + 1, len(trees)) if len(trees) < S.TREES else F.col("labels")
    rows = signed.select(group, F.xxhash64(group).alias("family"), key, "n", *WORDS, *extra, F.posexplode(labels).alias("tree", "label"))
    rows = rows.withColumn("tree", F.col("tree") + trees.start).withColumn("run", _run(group, depth)).drop("tree", "label")
    if hot is None:
        return rows.withColumn("block", F.lit(0))
    own = F.pmod(F.xxhash64(key, F.lit(13)), F.col("blocks")).cast("int")
    joined = rows.join(hot, "run", "left").withColumn("block", F.coalesce(own, F.lit(0)))
    split = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("run", F.least("block", j), F.greatest("block", j)))
    return joined.withColumn("run", F.explode(F.coalesce(split, F.array("run")))).drop("blocks")


def _compare(run: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, threshold: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions within equal ``run`` values (sorted) that may be similar."""
    edges = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1], [True]]))
    lengths = np.diff(edges)
    first, second = [], []
    for length in np.unique(lengths[lengths > 1]).tolist():
        starts = edges[:-1][lengths == length]
        if length <= SHORT_RUN:
            i, j = np.triu_indices(length, 1)
            step = max(1, AT_ONCE // len(i))
            for at in range(0, len(starts), step):
                a = (starts[at : at + step, None] + i).ravel()
                b = (starts[at : at + step, None] + j).ravel()
                near = alike(sizes, sketches, a, b, threshold, least)
                first.append(a[near]), second.append(b[near])
        else:
            for start in starts.tolist():
                tree = SignatureTree(sizes[start : start + length], sketches[start : start + length])
                a, b = tree.pairs(threshold, least)
                first.append(a + start), second.append(b + start)
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(first), np.concatenate(second)


def candidates(signed: DataFrame, group: str, key: str, threshold: float, fresh: str | None = None, passes: int = 1) -> DataFrame:
    """Distinct ``group, id_a, id_b`` (``id_a < id_b``) that a tree of the forest brings together and sketches allow.

    With ``fresh``, a boolean column, only pairs with a fresh record are compared. In several ``passes`` the trees take turns,
    so that the entries of a part of them lie on disk at a time; ``signed`` is read in each and should be materialised.
    """
    depth, least = depth_for(threshold), S.least_agreeing(threshold)
    extra = [fresh] if fresh else []
    hot = _hot(signed, group, key, depth)
    kind = signed.select(group).schema[0].dataType.simpleString()
    columns = ["run", group, "family", key, "n", *WORDS, "block", *extra]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            array = lambda name: table.column(name).to_numpy()
            run, sizes, block = array("run"), array("n"), array("block")
            sketches = np.stack([array(f"s{w}") for w in range(S.WORDS)], axis=1)
            a, b = _compare(run, sizes, sketches, threshold, least)
            ids = array(key)
            whole = np.ones(len(run), bool)
            if block.any():
                edges = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
                lows, highs = np.minimum.reduceat(block, edges), np.maximum.reduceat(block, edges)
                whole = np.repeat(lows == highs, np.diff(np.append(edges, len(run))))
            family = array("family")
            good = (family[a] == family[b]) & (ids[a] != ids[b]) & (whole[a] | (block[a] != block[b]))
            if fresh:
                new = array(fresh)
                good &= new[a] | new[b]
            a, b = a[good], b[good]
            if len(a):
                low, high = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
                groups = table.column(group).combine_chunks().take(pa.array(a))
                out = pa.Table.from_arrays([groups, pa.array(low), pa.array(high)], [group, "id_a", "id_b"])
                yield from out.group_by([group, "id_a", "id_b"]).aggregate([]).to_batches()

        rows = 0
        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows < 200_000:
                continue
            table = pa.Table.from_batches(kept)
            run = table.column("run").to_numpy()
            end = int(np.searchsorted(run, run[-1]))
            if end:
                yield from found(table.slice(0, end))
                kept = table.slice(end).to_batches()
                rows = sum(b.num_rows for b in kept)
        if rows:
            yield from found(pa.Table.from_batches(kept))

    parts = parallelism(signed.sparkSession)

    def met(trees: range) -> DataFrame:
        entries = _entries(signed, group, key, depth, extra, hot, trees)
        ordered = entries.select(*columns).repartition(parts, "run").sortWithinPartitions("run")
        return ordered.mapInArrow(search, f"`{group}` {kind}, id_a long, id_b long").dropDuplicates([group, "id_a", "id_b"])

    if passes == 1:
        return met(range(S.TREES))
    step, found = -(-S.TREES // passes), []
    for at in range(0, S.TREES, step):
        found.append(cut(met(range(at, min(at + step, S.TREES)))))
        release(signed.sparkSession)
    return reduce(DataFrame.unionByName, found).dropDuplicates([group, "id_a", "id_b"])


def verify(pairs: DataFrame, texts: DataFrame, group: str, width: int, threshold: float) -> DataFrame:
    """The pairs whose exact similarity reaches the threshold, with ``common`` and ``either`` (counts of shingles).

    ``pairs`` should be materialised; ``texts`` has ``group, id, text``.
    """
    ids = pairs.select(group, F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    few = 2 * pairs.count() <= BROADCAST_IDS
    wanted = texts.join(F.broadcast(ids) if few else ids, [group, "id"], "left_semi")
    both = pairs.join(wanted.select(group, F.col("id").alias("id_a"), F.col("text").alias("text_a")), [group, "id_a"])
    both = both.join(wanted.select(group, F.col("id").alias("id_b"), F.col("text").alias("text_b")), [group, "id_b"])
    kind = pairs.select(group).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = S.Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                texts = list(dict.fromkeys(part.column(3).to_pylist() + part.column(4).to_pylist()))
                sets = dict(zip(texts, shingler.many(texts)))
                left, right = ([sets[t] for t in part.column(c).to_pylist()] for c in (3, 4))
                shared = np.array([S.common(x, y) for x, y in zip(left, right)], np.int64)
                either = np.array([len(x) + len(y) for x, y in zip(left, right)], np.int64) - shared
                good = pa.array((shared >= threshold * either) & (either > 0))
                columns = [*part.columns[:3], pa.array(shared), pa.array(either)]
                yield pa.RecordBatch.from_arrays(columns, [group, "id_a", "id_b", "common", "either"]).filter(good)

    return both.select(group, "id_a", "id_b", "text_a", "text_b").mapInArrow(run, f"`{group}` {kind}, id_a long, id_b long, common long, either long")


def similar(df: DataFrame, group: str, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Similar pairs of representatives, and every record's representative.

    ``df`` has ``group, id, text``. Returns (``group, id_a, id_b, common, either``) and (``group, id, rep_id``); the
    second has a row for every record that has a shingle. Both are materialised.
    """
    signed = cut(sign(df, [group, "id"], F.col("text"), width))
    repeats = cut(repeated(signed, group, ["id"]))
    reps = signed.join(repeats, [group, "id"], "left_anti")
    members = signed.select(group, "id").join(repeats, [group, "id"], "left").select(group, "id", F.coalesce("rep_id", "id").alias("rep_id"))
    pairs = cut(candidates(reps, group, "id", threshold))
    release(df.sparkSession)
    return cut(verify(pairs, df, group, width, threshold)), members


def expand(pairs: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """``group, id_a, id_b`` of all records: the pairs of their representatives, and copies of each other.

    The result is as large as it must be: a group of copies has all its pairs. Use ``classes`` where that is too much.
    """
    sizes = members.filter("id != rep_id").groupBy(group, "rep_id").agg(F.count("*").alias("copies"))
    large = cut(sizes.filter(F.col("copies") >= EXPAND).select(group, "rep_id", F.ceil(F.col("copies") / EXPAND).cast("int").alias("parts")))
    salted = not large.isEmpty()

    def salt(left: DataFrame, rep: str) -> DataFrame:
        """Rows of the left side, spread over the parts of a large group."""
        if not salted:
            return left.withColumn("part", F.lit(0))
        own = F.pmod(F.xxhash64("left_id", F.lit(17)), F.col("parts")).cast("int")
        return left.join(large.withColumnRenamed("rep_id", rep), [group, rep], "left").withColumn("part", F.coalesce(own, F.lit(0))).drop("parts")

    def spread(right: DataFrame, rep: str) -> DataFrame:
        """Rows of the right side, once for each part."""
        if not salted:
            return right.withColumn("part", F.lit(0))
        found = right.join(large.withColumnRenamed("rep_id", rep), [group, rep], "left")
        return found.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")

    left = members.select(group, F.col("rep_id").alias("id_a"), F.col("id").alias("left_id"))
    right = members.select(group, F.col("rep_id").alias("id_b"), F.col("id").alias("right_id"))
    across = salt(pairs.select(group, "id_a", "id_b").join(left, [group, "id_a"]), "id_b").join(spread(right, "id_b"), [group, "id_b", "part"])
    copied = members.filter("id != rep_id").select(group, "rep_id", "id")
    heads = copied.select(group, "rep_id").distinct().select(group, "rep_id", F.col("rep_id").alias("id"))
    within = copied.unionByName(heads)
    other = within.select(group, "rep_id", F.col("id").alias("right_id"))
    inside = salt(within.withColumnRenamed("id", "left_id"), "rep_id").join(spread(other, "rep_id"), [group, "rep_id", "part"]).filter("left_id < right_id")
    both = across.select(group, "left_id", "right_id").unionByName(inside.select(group, "left_id", "right_id"))
    return both.select(group, F.least("left_id", "right_id").alias("id_a"), F.greatest("left_id", "right_id").alias("id_b"))


def classes(pairs: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """``group, id, rep_id, class_id, links`` of all records with a link or a copy; nothing is expanded.

    ``class_id`` is the smallest id of what links and copies connect, ``links`` the number of similar representatives.
    """
    kinds = [r[0] for r in members.select(group).distinct().collect()]  # few by nature: one for each table compared
    number = F.create_map(*(x for i, k in enumerate(sorted(kinds)) for x in (F.lit(k), F.lit(i)))) if kinds else F.lit(None)
    slot = lambda name: F.col(name) * F.lit(max(1, len(kinds))) + number[F.col(group)]
    if not kinds:
        return members.select(group, "id", "rep_id", F.col("rep_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    found = components(pairs.select(slot("id_a").alias("id_a"), slot("id_b").alias("id_b")))
    ends = pairs.select(group, F.explode(F.array("id_a", "id_b")).alias("rep_id")).groupBy(group, "rep_id").agg(F.count("*").alias("links"))
    connected = ends.withColumn("slot", slot("rep_id")).join(found.withColumnRenamed("id", "slot"), "slot")
    connected = connected.select(group, "rep_id", "links", F.floor(F.col("component") / len(kinds)).cast("long").alias("class_id"))
    copied = members.filter("id != rep_id").select(group, "rep_id").distinct().withColumn("copied", F.lit(True))
    joined = members.join(connected, [group, "rep_id"], "left").join(copied, [group, "rep_id"], "left").filter("links IS NOT NULL OR copied")
    return joined.select(group, "id", "rep_id", F.coalesce("class_id", "rep_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
