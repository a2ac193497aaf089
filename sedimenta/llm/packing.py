"""Problem 7: items packed into containers of fixed capacity by first-fit decreasing with a tournament tree.

Documents are dealt at random into groups of bounded size; each group is packed on its own, so the work is parallel,
no group grows with the data, and a group's only waste is its last, partly filled containers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of one group, as an expected number.
GROUP = 4096


def first_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[int]:
    """The bin of each item, bins numbered from 0 in order of their opening; no size may exceed ``capacity``.

    Larger items come first, equal sizes in their given order. A tournament tree over all possible bins holds at
    each node the most free space below, so the leftmost bin that can take an item is found in one descent.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    width = 1
    while width < len(sizes):
        width *= 2
    free = [capacity] * (2 * width)
    bins = [0] * len(sizes)
    for item in order:
        need, node = sizes[item], 1
        while node < width:
            node *= 2
            if free[node] < need:
                node += 1
        bins[item] = node - width
        left = free[node] - need
        while True:
            free[node] = left
            if node == 1:
                break
            other = free[node ^ 1]
            left = max(left, other)
            node //= 2
            if free[node] == left:
                break
    return bins


def pack(sized: DataFrame, n_items: int, capacities: list[tuple[int, int]], key: str, size: str, group: int = GROUP) -> DataFrame:
    """``container_id, capacity, group_no, bin_no, key, part_no, start_token, part_tokens`` of every item.

    An item is whole unless it exceeds the capacity; then its full parts fill a container each and its rest is packed
    like an item. An item of size 0 lies in the first container with room. An item of null size has one row per
    capacity with null ``bin_no`` and ``part_tokens``. ``capacities`` holds (container_id, capacity), few by nature; a
    capacity that is null or below 1 takes nothing. ``n_items`` sets the number of groups only.
    """
    groups = max(1, math.ceil(n_items / group))
    kind = sized.select(F.col(key)).schema[0].dataType.simpleString()
    usable = [(int(i), int(c)) for i, c in capacities if i is not None and c is not None and c > 0]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([key, "size"], kind="stable", ignore_index=True)
        keys, missing = part[key].to_numpy(), part["size"].isna().to_numpy()
        sizes = part["size"].fillna(0).to_numpy(np.int64)
        out = []
        for container, capacity in usable:
            times = np.maximum(1, -(-sizes // capacity))
            of = np.repeat(np.arange(len(part)), times)
            number = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            start = number * capacity
            tokens = np.minimum(capacity, sizes[of] - start)
            there = ~missing[of]
            bins = np.full(len(of), -1, np.int64)
            bins[there] = first_fit_decreasing(tokens[there].tolist(), capacity)
            frame = pd.DataFrame({"container_id": container, "capacity": capacity, "group_no": part["group_no"].iloc[0], "bin_no": bins, key: keys[of], "part_no": number, "start_token": start, "part_tokens": tokens})
            frame = frame.astype({"bin_no": "Int64", "part_tokens": "Int64"})
            frame.loc[~there, ["bin_no", "part_tokens"]] = pd.NA
            out.append(frame)
        return pd.concat(out) if out else pd.DataFrame(columns=["container_id", "capacity", "group_no", "bin_no", key, "part_no", "start_token", "part_tokens"])

    dealt = sized.select(F.col(key), F.col(size).cast("long").alias("size"), F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(groups)).alias("group_no"))
    return dealt.groupBy("group_no").applyInPandas(run, f"container_id int, capacity int, group_no long, bin_no long, `{key}` {kind}, part_no int, start_token long, part_tokens long")


def fill(packed: DataFrame) -> DataFrame:
    """Per container size: containers used, tokens in them and the share of their room that is filled."""
    bins = packed.filter("bin_no IS NOT NULL").groupBy("container_id", "capacity", "group_no", "bin_no").agg(F.sum("part_tokens").alias("tokens"))
    return bins.groupBy("container_id", "capacity").agg(
        F.count("*").alias("containers"),
        F.sum("tokens").alias("tokens"),
        F.max("tokens").alias("fullest"),
        (F.sum("tokens") / (F.count("*") * F.first("capacity"))).alias("filled"),
    )
