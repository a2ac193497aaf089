"""SimHash fingerprints, their bands and the Hamming distance join."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import text as T
from sedimenta.session import cut

BITS, MAX_HAMMING, MIN_WIDTH = 64, 3, 8
#: Rows that may share a key on average if prints were random (real ones cluster), by which the keys of the join are made as long as the corpus needs.
ROWS_A_KEY = 0.02
#: Prints under one key from which the key is split into pairs of blocks.
HOT, BLOCK = 4096, 2048


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, fingerprint``; texts without a token all have 0."""
    return df.select(key, T.simhash(F.col(text)).alias("fingerprint"))


def classes(prints: DataFrame, key: str) -> DataFrame:
    """``fingerprint, rep_id, members``: each distinct fingerprint with its smallest key."""
    return prints.groupBy("fingerprint").agg(F.min(key).alias("rep_id"), F.count("*").alias("members"))


def bands(prints: DataFrame, key: str, max_hamming: int = MAX_HAMMING) -> DataFrame:
    """``key, band, band_key, fingerprint``: max_hamming + 1 bands; two prints within the distance agree in one of them."""
    count = max_hamming + 1
    width = BITS // count
    if max_hamming < 1 or width < MIN_WIDTH:
        raise ValueError("bands need a width of at least 8 bits, so a distance from 1 to 7")
    mask = F.lit((1 << width) - 1).cast("long")
    keys = F.array(*(F.shiftrightunsigned("fingerprint", i * width).bitwiseAND(mask) for i in range(count)))
    return prints.select(key, "fingerprint", F.posexplode(keys).alias("band", "band_key"))


def blocks_for(rows: int, max_hamming: int) -> tuple[int, int]:
    """(blocks, agreeing blocks) of a key scheme: two prints within the distance agree in at least blocks - distance of the blocks.

    The more rows, the longer the keys: of all schemes up to distance + 4 blocks, the one with the fewest keys a print
    that leaves at most ``ROWS_A_KEY`` rows a key if prints were random, else the one with the longest keys.
    """
    best = None
    for blocks in range(min(BITS, max_hamming + 1), min(BITS, max_hamming + 4) + 1):
        agree = max(0, blocks - max_hamming)
        bits = agree * (BITS // blocks)
        keys = comb(blocks, agree)
        enough = rows / 2.0 ** min(bits, 60) <= ROWS_A_KEY
        rank = (not enough, keys if enough else -bits, keys)
        if best is None or rank < best[0]:
            best = (rank, (blocks, agree))
    return best[1]


def block_keys(prints: DataFrame, key: str, blocks: int, agree: int) -> DataFrame:
    """``key, fingerprint, slot, band_key``: for each choice of ``agree`` blocks their bits, put together."""
    width = BITS // blocks
    widths = [width] * (blocks - 1) + [BITS - width * (blocks - 1)]
    starts = [width * i for i in range(blocks)]
    keys = []
    for chosen in combinations(range(blocks), agree):
        mask = sum(((1 << widths[i]) - 1) << starts[i] for i in chosen)
        keys.append(F.col("fingerprint").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long")))
    return prints.select(key, "fingerprint", F.posexplode(F.array(*keys)).alias("slot", "band_key"))


def _split_hot(rows: DataFrame) -> DataFrame:
    """Adds ``part`` (and copies rows) so that no key holds more than some thousands of rows: a hot key's rows are put into blocks,
    and each pair of blocks meets under a part of its own."""
    counts = rows.groupBy("slot", "band_key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT)
    hot = cut(counts.select("slot", "band_key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    if hot.isEmpty():
        return rows.withColumn("part", F.lit(0).cast("long")).withColumn("block", F.lit(0))
    joined = rows.join(hot, ["slot", "band_key"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"), F.lit(0)))
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda j: F.least("block", j).cast("long") * (1 << 20) + F.greatest("block", j))
    return joined.withColumn("part", F.explode(pairs)).drop("blocks")


def similar_pairs(prints: DataFrame, key: str, max_hamming: int = MAX_HAMMING) -> DataFrame:
    """``id_a, id_b, distance`` between the representatives of different fingerprints within the distance.

    Equal fingerprints are one class (see ``classes``), so a group of copies takes part once however large it is; at distance
    0 nothing is left to find. Keys grow with the corpus (``blocks_for``), so candidates stay in proportion to it. Lossless for every
    distance: the wider it is, the shorter the keys, until at 64 every pair is within it and met as one.
    """
    kind = prints.select(key).schema[0].dataType.simpleString()
    if max_hamming <= 0:
        return prints.sparkSession.createDataFrame([], f"id_a {kind}, id_b {kind}, distance int")
    reps = cut(classes(prints, key).select("rep_id", "fingerprint"))
    blocks, agree = blocks_for(reps.count(), max_hamming)
    rows = _split_hot(block_keys(reps, "rep_id", blocks, agree))
    on = ["slot", "band_key", "part"]
    a = rows.select(*on, F.col("rep_id").alias("id_a"), F.col("fingerprint").alias("f_a"), F.col("block").alias("block_a"))
    b = rows.select(*on, F.col("rep_id").alias("id_b"), F.col("fingerprint").alias("f_b"), F.col("block").alias("block_b"))
    differ = F.col("f_a").bitwiseXOR(F.col("f_b"))
    near = a.join(b, on).filter((F.col("id_a") < F.col("id_b")) & (F.bit_count(differ) <= max_hamming))
    near = near.filter((F.col("part") == 0) | (F.col("part") == F.least("block_a", "block_b").cast("long") * (1 << 20) + F.greatest("block_a", "block_b")))
    return near.select("id_a", "id_b", F.bit_count(differ).alias("distance")).distinct()
