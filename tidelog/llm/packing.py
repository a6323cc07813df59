"""Best-fit packing with a dominance reduction.

Documents become token pieces of at most ``capacity``; only longer documents are cut, and their first piece takes
the remainder. All that packing needs of the corpus is how many pieces there are of each length: a table of at most
``capacity`` rows. On it the driver first fixes, from the longest length to the shortest, sets of at most three pieces that
provably dominate every other set with that piece (an exact or largest partner where no second one fits, or two partners
that bound each alternative), for as many copies at once as there are; lengths without such a set are passed over. The rest is packed best fit, longest first. The
result is a table of slots whose size depends on the number of lengths, not of documents; each piece finds its slot
by its rank among the pieces of its length, which is counted in two levels so that no length meets in one task.

Null texts count as empty (one piece, the end mark alone). Texts of any length are encoded whole. Rows that repeat an
id are packed as documents of their own. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import struct
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, map_rows, whole_text

CAPACITY, END = 1024, 2

_tokenizers: dict[str, "Tokens"] = {}


# Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokens:
    """The ids that the ``tokenizers`` library gives for a byte-level BPE file (ids in the order of merges).

    That library took 460 CPU seconds a GB of tables here, so its vocabulary is read into a faster encoder of the
    same ids, added tokens such as ``<|endoftext|>`` included, as the library's plain call reads them; tests hold the
    two against each other."""

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        # byte-level files write printable bytes as themselves and the others, in order, as characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}  # found in a text before anything else
        # ids must rank the merges, as the faster encoder merges by id
        merged = [spec["model"]["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        if merged != sorted(set(merged)):
            raise ValueError(f"the ids of {path} are not in the order of its merges")
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encode = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special).encode_to_numpy

    def packed(self, text: str) -> bytes:
        return self.encode(text, allowed_special="all").astype("<u4").tobytes()


def tokens(path: str) -> Tokens:
    """One for a worker process, shared by its tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = Tokens(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32)."""

    def make():
        tok = tokens(path)
        mark = struct.pack("<I", end)

        def step(b):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = tok.packed(text) + mark
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    for name, v in zip(out, (doc, k, s, e - s, crc32(ids[4 * s : 4 * e]))):
                        out[name].append(v)
            return out

        return step

    return map_rows(docs, ["doc_id", whole_text().alias("text")], "doc_id long, piece int, start long, length long, ids_crc32 long", make)


def dominating(count: list[int], i: int, capacity: int) -> tuple[int, ...] | None:
    """Partners of a piece of length ``i``, of all pieces left, in a set that dominates all its other sets, or None.
    Dominates: the pieces of any other set can take their places, so some optimum has this set."""
    room = capacity - i
    here = [x for x in range(room, 0, -1) if count[x] - (x == i) > 0]
    if not here:
        return ()
    most, least = here[0], here[-1]
    left = lambda x: count[x] - (x == i)
    second = least if left(least) > 1 else (here[-2] if len(here) > 1 else room + 1)
    if most == room or least + second > room:
        return (most,)  # no set has more than what the largest partner's place can take
    small = [x for x in reversed(here) for _ in range(min(3, left(x)))][:3]
    if len(small) == 3 and sum(small) <= room:
        return None
    # two partners at most: (most, b) dominates if no other pair's lesser piece exceeds b
    rest = [x for x in here if x <= room - most and (x != most or left(x) > 1)]
    if not rest:
        return None
    b = rest[0]
    for x in here:  # x: the greater piece of a pair; y: the largest lesser piece that fits with it
        y = next((y for y in here if y <= min(x, room - x) and (y != x or left(x) > 1)), 0)
        if y > b:
            return None
    return (most, b)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Patterns of lengths with how often each is used, and how many sequences the reduction fixed."""
    count = [0] * (capacity + 1)
    for length, n in histogram.items():
        count[length] += n
    out: list[tuple[tuple[int, ...], int]] = []
    i = capacity
    while i:
        if not count[i]:
            i -= 1
            continue
        partners = dominating(count, i, capacity)
        if partners is None:
            i -= 1
            continue
        lengths = (i, *partners)
        # as often as the argument stays the same: counts of up to three are looked at one by one
        times = min(count[x] // lengths.count(x) for x in lengths)
        times = times - 3 if times > 4 else 1
        for x in lengths:
            count[x] -= times
        out.append((lengths, times))
    fixed = sum(n for _, n in out)
    # best fit, longest first: bins by the room they have left
    bins: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        n = count[length]
        room = length
        while n:
            while room <= capacity and not bins[room]:
                room += 1
            if room > capacity:  # new sequences, each filled with what fits as best fit would
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    bins[capacity - each * length].append(((length,) * each, full))
                if rest:
                    bins[capacity - rest * length].append(((length,) * rest, 1))
                break
            pattern, many = bins[room].pop()
            each = room // length
            full = min(many, n // each)
            if full:
                bins[room - each * length].append((pattern + (length,) * each, full))
                n -= full * each
                many -= full
            if many and n and n < each:
                bins[room - n * length].append((pattern + (length,) * n, 1))
                n, many = 0, many - 1
            if many:
                bins[room].append((pattern, many))
    return out + [p for room in bins for p in room], fixed


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, first sequence, offset) by rank."""
    found: dict[int, list] = {}
    used: dict[int, int] = {}
    base = 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            found.setdefault(x, []).append((used.get(x, 0), base, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        base += times
    return {x: np.array(rows, np.int64) for x, rows in found.items()}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cutted = cut(pieces(docs, path, capacity, end), "pieces")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = cutted.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = placed.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    before = counts.select("bucket", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("base"))
    histogram = {r["length"]: r["n"] for r in cutted.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    table = slots(plan(histogram, capacity)[0])
    inside = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = placed.withColumn("inside", inside).join(before, ["bucket", "length"]).withColumn("rank", F.col("base") + F.col("inside"))

    def make():
        def step(b):
            length, rank = np.array(b["length"], np.int64), np.array(b["rank"], np.int64)
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                rows = table[x]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                seq[at], offset[at] = row[:, 1] + rank[at] - row[:, 0], row[:, 2]
            return b | {"sequence_id": seq, "offset": offset}

        return step

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return map_rows(ranked, [*names, "rank"], "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", make)
