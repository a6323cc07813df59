"""Comparing the members of grid cells without ever gathering an unbounded cell in one task.

Cells with one member vanish in a join with the counts. A cell of over ``limit`` members is dealt into chunks,
and each pair of chunks becomes a block of its own: all pairs of the cell meet, none is dropped, and a block has
2 x ``limit`` members or so. Blocks come sorted to a task, which holds one batch at a time, and pairs are made
as numpy arrays, never as rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

LIMIT = 1024


def deal(points: DataFrame, limit: int = LIMIT) -> DataFrame:
    """points: (cell, uid, ...). Returns (cell, lo, hi, side, uid, ...): side 0 in chunk lo, 1 in chunk hi (lo = hi: 0)."""
    sizes = points.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = points.join(sizes, "cell").withColumn("chunks", F.ceil(F.col("n") / limit).cast("int")).withColumn("mine", F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int"))
    once = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rest = [c for c in points.columns if c != "cell"]
    return once.select("cell", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") > F.col("other")).cast("int").alias("side"), *rest)


def sorted_blocks(dealt: DataFrame, *inside: str) -> DataFrame:
    """Blocks whole and in one task each, their rows in the order of ``inside``."""
    return dealt.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi", *inside)


def whole_blocks(batches):
    """Regroups sorted record batches so that no block is divided between two of them; each comes as
    (table, block number of each row)."""
    left = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if left is not None:
            t = pa.concat_tables([left, t])
        if not t.num_rows:
            continue
        keys = np.stack([t.column(c).to_numpy() for c in ("cell", "lo", "hi")])
        new = np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)]
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield t.slice(0, last), np.cumsum(new[:last])
        left = t.slice(last).combine_chunks()
    if left is not None and left.num_rows:
        yield left, np.ones(left.num_rows, np.int64)


def pairs(block: np.ndarray, crossing: np.ndarray, side: np.ndarray, value: np.ndarray | None = None, reach: int = 0):
    """Arrays (i, j) of all pairs of rows in one block, by their distance; a crossing block pairs unlike sides only.
    With ``value``, by which each block is sorted, only pairs whose values are within ``reach``: a row leaves the search
    with the first row out of its reach."""
    i = np.arange(len(block) - 1)
    step = 1
    while len(i):
        i = i[i + step < len(block)]
        i = i[block[i] == block[i + step]]
        if value is not None:
            i = i[value[i + step] - value[i] <= reach]
        j = i + step
        wanted = ~crossing[i] | (side[i] != side[j])
        for at in range(0, len(i), 200_000):
            w = wanted[at : at + 200_000]
            yield i[at : at + 200_000][w], j[at : at + 200_000][w]
        step += 1


class Forest:
    """Keeps of many links only those that join two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        apart = root[i] != root[j]
        if not apart.any():
            return
        up = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for a, b in zip(i[apart].tolist(), j[apart].tolist()):
            p, q = top(int(root[a])), top(int(root[b]))
            if p != q:
                up[max(p, q)] = min(p, q)
                self.links.append((a, b))
        if up:
            to = np.arange(len(root))
            for x in up:
                to[x] = top(x)
            self.root = to[root]


def run_blocks(blocks: DataFrame, schema, kernel: Callable) -> DataFrame:
    """kernel(table, block, crossing, side) -> record batches, for each group of whole blocks."""

    def run(batches):
        for t, block in whole_blocks(batches):
            crossing = t.column("lo").to_numpy() != t.column("hi").to_numpy()
            yield from kernel(t, block, crossing, t.column("side").to_numpy())

    ship(blocks.sparkSession)
    return blocks.mapInArrow(run, schema)
