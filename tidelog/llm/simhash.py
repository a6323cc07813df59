"""SimHash near-duplicates: segment popcounts, a grid join under Manhattan distance, exact verification.

A fingerprint is mapped to the popcounts of its 32 two-bit segments. The Manhattan distance of two such vectors
is at most the Hamming distance of the fingerprints, so it bounds it from below. The grid: the segments form a number of
blocks; vectors within Manhattan distance d agree on all segments of at least blocks - d blocks, so
for some choice of that many blocks both stand in the same grid cell. Inside a cell a range join: the sums of two vectors
differ by no more than their Manhattan distance, so the members, sorted by their sums, are compared only with those in
reach. Pairs whose Manhattan distance is within d are verified on the bits. No linked pair is missed, whatever the sizes.

More blocks mean more cells a point and fewer strangers in each. ``blocks_for`` chooses them by the number of points: the
result is the same with any. For fingerprints that are nothing alike and d = 4 this gives, for each point, cells and pairs
of strangers to compare: 6 blocks, 15 and 50 at 235,000 points; 7 blocks, 35 and 250 at 10 million; 9 blocks, 126 and
1,700 at a billion.

Copies of a fingerprint are one point, so groups of copies of any size cost one row; large cells are divided
into blocks (see ``cells``); a block returns a spanning forest of its links, not all of them.

Null texts count as empty; texts without words have fingerprint zero, linked like any other. Rows without id
get a fingerprint and the component of their fingerprint, but are never its smallest id. Repeated rows are rows
of their own. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import Forest, deal, pairs, run_blocks, sorted_blocks
from .common import cut, map_rows, whole_text
from .components import components, splittable

DISTANCE, SHINGLE, SEED = 4, 4, 42
ROW, PAIR = 1500, 30  # nanoseconds that a point in a cell and a compared pair take, roughly
AGREE = math.log2(8 / 3)  # bits that a segment tells: two counts are equal with probability 3/8
EVEN = np.uint64(0x5555555555555555)


def fingerprint(text: str, size: int = SHINGLE) -> int:
    import xxhash

    words = text.encode().lower().split()  # bytes: letters A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def segment_popcounts(fp: np.ndarray) -> np.ndarray:
    """Popcounts of the two-bit segments, each in the two bits of its segment (0, 1 or 2)."""
    return (fp & EVEN) + ((fp >> np.uint64(1)) & EVEN)


def manhattan(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of vectors of two-bit counts: the sum of the larger minus the sum of the smaller."""
    a, b = p & EVEN, (p >> np.uint64(1)) & EVEN
    c, d = q & EVEN, (q >> np.uint64(1)) & EVEN
    # counts are 0, 1, 2: they differ by two where one is 2 and the other 0, by one where parities differ
    two = (b & ~d & ~c & EVEN) | (d & ~b & ~a & EVEN)
    return (np.bitwise_count(a ^ c) + 2 * np.bitwise_count(two)).astype(np.int64)


def blocks_for(points: int, distance: int = DISTANCE) -> int:
    """The number of blocks that costs least for so many points that are nothing alike; two more than ``distance`` at least."""

    def cost(blocks: int) -> float:
        cells = math.comb(blocks, distance)
        strangers = points / 2 ** (AGREE * 32 * (blocks - distance) / blocks) / 2
        return cells * (ROW + PAIR * strangers)

    return min(range(distance + 2, min(33, distance + 13)), key=cost)


def masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """For each choice of blocks - distance blocks, the bits of their segments."""
    parts = np.array_split(np.arange(32), blocks)
    of = [sum(3 << int(2 * s) for s in part) for part in parts]
    return [sum(of[k] for k in choice) for choice in combinations(range(blocks), blocks - distance)]


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def make():
        return lambda b: {"doc_id": b["doc_id"], "fp": [f - (1 << 64) if (f := fingerprint(t, size)) >> 63 else f for t in b["text"]]}

    return map_rows(docs, ["doc_id", whole_text().alias("text")], "doc_id long, fp long", make)


def links(points: DataFrame, distance: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """points: (fp), distinct. Links (a, b) of fingerprints that connect whatever is within ``distance``."""
    chosen = masks(blocks or blocks_for(points.count(), distance), distance)
    fp = F.col("fp")
    even = F.lit(int(EVEN))
    low, high = fp.bitwiseAND(even), F.shiftrightunsigned(fp, 1).bitwiseAND(even)
    counts = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))  # low + high, without overflow checks
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    cells = F.array(*[F.xxhash64(F.lit(k), F.col("counts").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)])
    parts = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = points.select(fp.alias("uid"), counts.alias("counts")).repartition(parts, F.xxhash64("uid"))  # few bytes, many rows to come
    spread = dealt.select("uid", F.explode(cells).alias("cell"))
    met = sorted_blocks(deal(spread).withColumn("total", F.bit_count("uid")), "total")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def kernel(t, block, crossing, side):
        own = t.column("uid").to_numpy()
        bits = own.view(np.uint64)
        vectors = segment_popcounts(bits)
        forest = Forest(len(own))
        for i, j in pairs(block, crossing, side, t.column("total").to_numpy(), distance):
            near = manhattan(vectors[i], vectors[j]) <= distance
            i, j = i[near], j[near]
            near = np.bitwise_count(bits[i] ^ bits[j]) <= distance
            forest.add(i[near], j[near])
        if forest.links:
            a, b = np.array(forest.links).T
            yield pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(own[b])], schema=schema)

    return run_blocks(met, "a long, b long", kernel).distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    prints = cut(fingerprints(docs, size), "fingerprints")
    points = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-points")
    found = components(links(points.select("fp"), distance)).select(F.col("v").alias("fp"), "root")
    rooted = points.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = splittable(rooted, least, "root").select("fp", "component_id")
    return prints.join(classes, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component (every row of that id), and rows without an id."""
    kept = near_duplicates(docs, distance, size).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter(F.col("doc_id").isNull()))
