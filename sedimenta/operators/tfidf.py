"""TF-IDF vectors and the cosine similarity join with a lossless prefix filter.

A pair reaches cosine t only if the two unit vectors share a term among the rarest terms whose removal would leave a
norm below t. Documents are packed into blocks; each pair of blocks is one task, which adds up the products of common
prefix terms in an inverted index, bounds the cosine from above by them and the norms that follow, and verifies what the bound
leaves. No candidate leaves its task. Vectors are non-negative after taking
absolute weights: a term's weights in two documents have the same sign.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.text import count_terms
from sedimenta.session import cut

THRESHOLD = 0.85
#: Slack for rounding: pairs this close below the threshold are still verified.
SLACK = 1e-9
#: Terms of more than one document up to which their frequencies are sent to the workers; beyond, they are joined by a shuffle.
VOCABULARY = 1_000_000
#: Copies up to which their ids are broadcast (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Documents and entries of a block, a bound on a task's memory (one chunk may go beyond), and documents of a chunk.
BLOCK, BLOCK_ENTRIES, CHUNK = 32_768, 4_000_000, 500
#: Least documents of a partition that packs blocks.
FEW = 4000
#: Places at which the norm of what follows is known for every document of a block.
PLACES = 16
#: Prefixes go on until the norm of what follows is less than the threshold by so much: more products, fewer vectors to compare.
FURTHER = 0.03
#: Documents whose products are looked up at once.
AT_ONCE = 32


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, n, total``: how often each document holds each term, and all its terms. Narrow: counted in the workers."""
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts = [count_terms(t) for t in part.column(1).to_pylist()]
                of = pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts]))
                totals = pa.array(np.repeat([sum(c.values()) for c in counts], [len(c) for c in counts]).astype(np.int64))
                terms = pa.array([t for c in counts for t in c], pa.string())
                ns = pa.array([n for c in counts for n in c.values()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), terms, ns, totals], [key, "term", "n", "total"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, term string, n long, total long")


def weights(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, n, df, tf, idf, weight``: tf is the share of the document's terms, idf is ln(documents / (1 + df)).

    All documents count, those without a term too.
    """
    counts = cut(term_counts(df, key, text))  # read twice: for the frequencies and for the weights
    frequency = counts.groupBy("term").agg(F.count("*").alias("df"))
    documents = df.agg(F.count("*").alias("documents"))
    joined = counts.join(frequency, "term").crossJoin(F.broadcast(documents))
    tf, idf = F.col("n") / F.col("total"), F.log(F.col("documents") / (1 + F.col("df")))
    return joined.select(key, "term", "n", "df", tf.alias("tf"), idf.alias("idf"), (tf * idf).alias("weight"))


def frequencies(df: DataFrame, text: str) -> DataFrame:
    """``term, df`` of the terms of more than one document; ``df`` of the null term is the number of documents. Counted in the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def counted() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])
            seen.clear()
            return rows

        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(count_terms(t).keys())
                seen[None] += 1
                if len(seen) > 500_000:
                    yield counted()
        yield counted()

    found = df.select(text).mapInArrow(run, "term string, n long")
    return found.groupBy("term").agg(F.sum("n").alias("df")).filter("term IS NULL OR df > 1")


def _chunk(keys: pa.Array, of: np.ndarray, codes: np.ndarray, ns: np.ndarray, idfs: np.ndarray, squares: np.ndarray, threshold: float) -> tuple:
    """Some documents' entries, sorted by document and code, with sizes of documents and prefixes; those that no other can resemble are left out."""
    w = ns * idfs
    w = w * w / squares[of]
    sizes = np.bincount(of, minlength=len(keys))
    beyond = np.append(np.cumsum(w[::-1])[::-1], 0.0)
    left = beyond[:-1] - beyond[np.cumsum(sizes)][of]
    heads = np.bincount(of[left >= max(0.0, threshold - FURTHER) ** 2], minlength=len(keys))
    able = np.bincount(of[left >= threshold * threshold - 4 * SLACK], minlength=len(keys)) > 0
    entries = able[of]
    return keys.filter(pa.array(able)), sizes[able], heads[able], codes[entries], ns[entries], idfs[entries], np.sqrt(squares[able])


def _packed(chunks: list[tuple]) -> pa.RecordBatch:
    """One block of some chunks, its documents in the order of the last code of their prefixes."""
    keys, (sizes, heads, codes, ns, idfs, norms) = pa.concat_arrays([c[0] for c in chunks]), (np.concatenate(x) for x in list(zip(*chunks))[1:])
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(codes[starts + heads - 1], kind="stable")
    entries = np.repeat(starts[order] - (np.cumsum(sizes[order]) - sizes[order]), sizes[order]) + np.arange(len(codes))
    vocabulary, first, own = np.unique(codes, return_index=True, return_inverse=True)
    block = (vocabulary, idfs[first], np.diff(own[entries].astype(np.int32), prepend=np.int32(0)), ns[entries].astype(np.int32), sizes[order].astype(np.int32), heads[order].astype(np.int32), norms[order])
    data = pickle.dumps(block, protocol=5)
    keys = keys.take(pa.array(order))
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([len(data)], pa.int64()), pa.array([pa.compress(data, "zstd", asbytes=True)], pa.binary())], ["ids", "size", "data"])


def _blocks(chunks: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Blocks of as many chunks as one may hold."""
    part, documents, entries = [], 0, 0
    for chunk in chunks:
        if part and (documents + len(chunk[0]) > BLOCK or entries + len(chunk[3]) > BLOCK_ENTRIES):
            yield _packed(part)
            part, documents, entries = [], 0, 0
        if len(chunk[0]):
            part.append(chunk)
            documents, entries = documents + len(chunk[0]), entries + len(chunk[3])
    if part:
        yield _packed(part)


def packed_vectors(df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """``block, ids, size, data``: the documents of different texts in blocks. Codes of terms ascend with their frequency.

    Terms of one document are no more than a part of its norm.
    """
    kind = df.select(key).schema[0].dataType.simpleString()
    schema = f"ids array<{kind}>, size long, data binary"
    known = cut(frequencies(df, text))
    many, documents = known.agg(F.count("term"), F.max(F.when(F.col("term").isNull(), F.col("df")))).first()
    documents = documents or 1
    partitions = math.ceil(documents / FEW)
    others = cut(copies(df, key, text).filter(F.col(key) != F.col("rep_id")).select(key))
    without = lambda rows: rows.join(F.broadcast(others) if others.count() <= BROADCAST_IDS else others, key, "left_anti")
    if many <= VOCABULARY:
        table = known.filter("term IS NOT NULL").orderBy("df", "term").toArrow()
        shared = df.sparkSession.sparkContext.broadcast((table.column(0).combine_chunks(), table.column(1).to_numpy()))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, dfs = shared.value
            code_of = dict(zip(terms.to_pylist(), range(len(terms))))
            idfs = np.abs(np.log(documents / (1.0 + np.append(dfs, 1))))  # the last is that of terms without a code

            def chunk(keys: pa.Array, counts: list[Counter]) -> tuple:
                of = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
                codes = np.fromiter((code_of.get(t, -1) for c in counts for t in c), np.int64, len(of))
                ns = np.fromiter((n for c in counts for n in c.values()), np.float64, len(of))
                squares = np.bincount(of, (ns * idfs[codes]) ** 2, len(counts))
                order = np.lexsort((codes, of))
                order = order[(codes[order] >= 0) & (idfs[codes[order]] != 0)]
                return _chunk(keys, of[order], codes[order], ns[order], idfs[codes[order]], squares, threshold)

            def chunks() -> Iterator[tuple]:
                for batch in batches:
                    start, entries, counts = 0, 0, []
                    for at, t in enumerate(batch.column(1).to_pylist(), 1):
                        counts.append(count_terms(t))
                        entries += len(counts[-1])
                        if len(counts) >= min(CHUNK, BLOCK) or entries > BLOCK_ENTRIES // 8 or at == batch.num_rows:
                            yield chunk(batch.column(0).slice(start, len(counts)), counts)
                            start, entries, counts = at, 0, []

            yield from _blocks(chunks())

        packed = without(df.select(key, text)).coalesce(partitions).mapInArrow(count, schema)
    else:
        # The order of terms is that of the powers of two in their frequency, then of their hashes.
        code = F.shiftleft(F.floor(F.log2("df")).cast("long"), 57).bitwiseOR(F.shiftrightunsigned(F.xxhash64("term"), 7))
        entry = F.when((F.col("df") > 1) & (F.col("idf") != 0), F.struct(code.alias("code"), F.col("n").cast("double").alias("n"), F.abs("idf").alias("idf")))
        long = weights(df, key, text).groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("v"), F.sum((F.col("n") * F.col("idf")) ** 2).alias("square"))
        plain = without(long).select(key, *(F.col(f"v.{c}").alias(c) for c in ("code", "n", "idf")), "square")

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def chunks() -> Iterator[tuple]:
                for batch in batches:
                    for start in range(0, batch.num_rows, min(CHUNK, BLOCK)):
                        part = batch.slice(start, min(CHUNK, BLOCK))
                        of = np.repeat(np.arange(part.num_rows), part.column(1).value_lengths().to_numpy())
                        yield _chunk(part.column(0), of, *(part.column(c).flatten().to_numpy() for c in (1, 2, 3)), part.column(4).to_numpy(), threshold)

            yield from _blocks(chunks())

        packed = plain.mapInArrow(gather, schema)
    blocks = cut(packed.withColumn("block", F.monotonically_increasing_id()))
    n, partitions = blocks.agg(F.count("*"), F.count_distinct(F.shiftright("block", 33))).first()
    return blocks.repartition(n, "block") if n > partitions else blocks


class _Block:
    """A block's vectors: entries with places in its own vocabulary, and where each document's entries and prefix end."""

    def __init__(self, size: int, data: bytes):
        self.codes, idf, places, ns, sizes, heads, norms = pickle.loads(pa.decompress(data, size, "zstd", asbytes=True))
        self.terms = np.cumsum(places, dtype=np.int64)
        self.n = len(sizes)
        self.of = np.repeat(np.arange(self.n), sizes)
        self.w = ns * idf[self.terms] / norms[self.of]
        self.ends = np.cumsum(sizes, dtype=np.int64)
        self.starts = self.ends - sizes
        head_ends = self.starts + heads
        self.heads = np.flatnonzero(np.arange(len(self.of)) < head_ends[self.of])
        self.last = self.codes[self.terms[head_ends - 1]]  # ascends
        beyond = np.append(np.cumsum((self.w * self.w)[::-1])[::-1], 0.0)
        self.rest = np.sqrt(np.maximum(0.0, beyond[head_ends] - beyond[self.ends]) + SLACK)  # more than any rounding of the sums

    def norms_beyond(self, places: np.ndarray) -> np.ndarray:
        """By number of places and document, the norm of the entries whose codes lie beyond so many places; never less than it is."""
        beyond = np.searchsorted(places, self.codes, "left")[self.terms]  # places that lie before the code
        square = np.bincount(beyond * self.n + self.of, self.w * self.w, (len(places) + 1) * self.n).reshape(-1, self.n)
        return np.sqrt(np.cumsum(square[::-1], 0)[::-1] + SLACK)


def _alike(a: _Block, b: _Block, same: bool, threshold: float) -> tuple[list[int], list[int], list[float]]:
    """Places of the pairs of two blocks (``same``: of one) and their cosines."""
    order = b.heads[np.argsort(b.terms[b.heads], kind="stable")]  # by term, then by document
    docs, values = b.of[order], b.w[order]
    ends = np.cumsum(np.bincount(b.terms[order], minlength=len(b.codes)))
    begins = ends - np.bincount(b.terms[order], minlength=len(b.codes))
    there = np.minimum(np.searchsorted(b.codes, a.codes), len(b.codes) - 1)
    there = np.where(b.codes[there] == a.codes, there, -1)  # a's vocabulary in b's
    heads = a.heads[there[a.terms[a.heads]] >= 0]
    terms = there[a.terms[heads]]
    froms, tos = begins[terms], ends[terms]
    if same:
        place = np.empty(len(b.w), np.int64)
        place[order] = np.arange(len(order))
        froms = place[heads] + 1  # only later documents
    some = tos > froms
    heads, froms, tos = heads[some], froms[some], tos[some]
    upto = np.searchsorted(heads, a.ends)
    lengths, weights_a = tos - froms, a.w[heads]
    sums = np.append(0, np.cumsum(lengths))
    # What prefixes don't show lies beyond the end of the shorter one in both vectors. Norms are known from places at or before that end.
    places = np.unique(b.last[np.linspace(0, b.n - 1, PLACES).astype(int)])
    norms_a, norms_b = np.ascontiguousarray(a.norms_beyond(places).T), b.norms_beyond(places)
    place_a, place_b = np.searchsorted(places, a.last, "right"), np.searchsorted(places, b.last, "right")
    split = np.searchsorted(b.last, a.last)
    least, found_a, found_b, cosines = threshold - SLACK, [], [], []
    dense = np.zeros(len(b.codes) + 1)
    for i in range(a.n):
        if i % AT_ONCE == 0:  # the products of some documents
            x, y = upto[i - 1] if i else 0, upto[min(i + AT_ONCE, a.n) - 1]
            where = np.repeat(froms[x:y] - sums[x:y], lengths[x:y]) + np.arange(sums[x], sums[y])
            met, products, before = docs[where], values[where] * np.repeat(weights_a[x:y], lengths[x:y]), sums[x]
        own = slice(sums[upto[i - 1] if i else 0] - before, sums[upto[i]] - before)
        if own.start == own.stop:
            continue
        bound, s = np.bincount(met[own], products[own], b.n), split[i]
        bound[:s] += b.rest[:s] * norms_a[i][place_b[:s]]
        bound[s:] += a.rest[i] * norms_b[place_a[i], s:]
        likely = np.flatnonzero(bound >= least - SLACK)
        if len(likely):
            own = slice(a.starts[i], a.ends[i])
            dense[there[a.terms[own]]] = a.w[own]
            dense[-1] = 0  # terms that b has not
            spans = list(zip(b.starts[likely].tolist(), b.ends[likely].tolist()))
            shares = dense[np.concatenate([b.terms[x:y] for x, y in spans])] * np.concatenate([b.w[x:y] for x, y in spans])
            sizes = b.ends[likely] - b.starts[likely]
            dots = np.add.reduceat(shares, np.cumsum(sizes) - sizes)
            enough = dots >= least
            found_a += [i] * int(enough.sum())
            found_b += likely[enough].tolist()
            cosines += dots[enough].tolist()
            dense[there[a.terms[own]]] = 0
    return found_a, found_b, cosines


def similar_pairs(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``id_a, id_b, cosine`` of all pairs of different texts with at least the threshold, ``id_a < id_b``.

    Equal texts have equal vectors; each set of them takes part once, as its smallest key (see ``copies``). Frequencies
    count all documents. ``threshold`` must be positive: at 0 every pair is similar and there is nothing to find.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    kind = df.select(key).schema[0].dataType.simpleString()
    blocks = packed_vectors(df, key, text, threshold)
    side = lambda s: blocks.select(*(F.col(c).alias(f"{c}_{s}") for c in ("block", "ids", "size", "data")))
    both = side("a").hint("shuffle_replicate_nl").join(side("b"), F.col("block_a") <= F.col("block_b"))  # reads the blocks where they are

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block_a, ids_a, size_a, data_a, block_b, ids_b, size_b, data_b = (batch.column(c)[row] for c in range(8))
                same = block_a == block_b
                a = _Block(size_a.as_py(), data_a.as_py())
                b = a if same else _Block(size_b.as_py(), data_b.as_py())
                found_a, found_b, cosines = _alike(a, b, same, threshold)
                yield pa.RecordBatch.from_arrays([ids_a.values.take(pa.array(found_a, pa.int64())), ids_b.values.take(pa.array(found_b, pa.int64())), pa.array(cosines, pa.float64())], ["id_a", "id_b", "cosine"])

    return both.mapInArrow(run, f"id_a {kind}, id_b {kind}, cosine double").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "cosine")


def copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, rep_id``: the smallest key among documents of equal text; null and empty texts are their own."""
    hashed = df.select(key, F.when(F.length(text) > 0, F.sha2(F.col(text), 256)).alias("same"))
    several = hashed.filter("same IS NOT NULL").groupBy("same").agg(F.min(key).alias("rep_id"), F.count("*").alias("n")).filter("n > 1")
    return hashed.join(several, "same", "left").select(key, F.coalesce("rep_id", F.col(key)).alias("rep_id"))


def top_terms(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """The ``k`` terms of greatest weight of each document, ties by term."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("weight", 9)), "term"))
    return weights(df, key, text).withColumn("rank", rank).filter(F.col("rank") <= k).select(key, "rank", "term", "n", "weight")
