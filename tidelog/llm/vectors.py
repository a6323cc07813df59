"""Embedding near-duplicates with randomised-rotation binary codes.

Vectors of one label and size are rotated at random. Stored for each: the signs as a binary code; the inner product of the
vector with its code, the correction factor; and the rotated coordinates rounded to four bits by a fixed random dither.
For a pair, the product of one vector's rounded coordinates with the other's code, over the other's factor, is an unbiased
estimate of the cosine, with an error bound that holds but with a tiny chance (``EPSILON`` standard deviations). Only where
the upper bound reaches the threshold are the vectors themselves fetched; these pairs are computed again in double
precision, and only the exact values make links.

Pairs come from cells: groups of signs of further rotations, so many to a cell that vectors that are nothing alike fill it
with some ``FULL`` members (``grid``, by the number of points of the largest label), and so many tables of cells that a pair
at the threshold shares none with a chance of ``MISS`` (see ``recall``). A pair is counted in the first table where it
meets, so counts need no second pass. Equal vectors are one point with a count, so that copies cost one row and link
exactly. Two rounds: codes meet in the cells, and only members with a pair inside the bound go on, with their vectors.

Vectors that are null, empty, zero, or hold null or non-finite components, null labels and null ids link with
nothing: n_links 0 and themselves as component (a null id: component null, kept false). Vectors of unlike sizes never
link. Rows that repeat an id count as vectors of their own, each with its own links. An empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import Forest, deal, pairs, run_blocks, sorted_blocks
from .common import cut, map_rows
from .components import components, splittable

THRESHOLD, SEED, EPSILON, MISS, FULL = 0.98, 11, 4.5, 1e-4, 64
HEAD = np.dtype([("factor", "<f4"), ("low", "<f4"), ("step", "<f4")])


def share(bits: int, threshold: float = THRESHOLD) -> float:
    """The chance that a pair at the threshold has equal signs, for independent ones."""
    return (1 - math.acos(threshold) / math.pi) ** bits


def grid(points: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(tables, bits) for so many points of one label."""
    bits = min(24, max(4, math.ceil(math.log2(max(1, points) / FULL))))
    return min(64, max(1, math.ceil(math.log(MISS) / math.log1p(-share(bits, threshold))))) if threshold < 1 else 1, bits


def recall(tables: int, bits: int, threshold: float = THRESHOLD) -> float:
    """The chance that a pair at the threshold meets in a cell."""
    return 1 - (1 - share(bits, threshold)) ** tables


@lru_cache(16)
def rotation(size: int, k: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, size, k]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def cell_codes(v: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Rows x tables of cell codes."""
    size = v.shape[1]
    need = tables * bits
    signs = np.concatenate([v @ rotation(size, k + 1).T > 0 for k in range(-(-need // size))], 1)[:, :need]
    return signs.reshape(len(v), tables, bits) @ (1 << np.arange(bits))


def unit(v: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that no length overflows or vanishes."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Codes:
    """What is stored of unit vectors of one size: codes, correction factors, rounded coordinates and cells."""

    def __init__(self, factor, low, step, signs, rounded, cells):
        self.factor, self.low, self.step, self.signs, self.rounded, self.cells = factor, low, step, signs, rounded, cells

    @staticmethod
    def of(u: np.ndarray, tables: int, bits: int) -> "Codes":
        size = u.shape[1]
        rotated = u @ rotation(size, 0).T
        signs = rotated > 0
        factor = np.abs(rotated).sum(1) / math.sqrt(size)
        low = rotated.min(1)
        step = np.maximum((rotated.max(1) - low) / 14, 1e-30)
        dither = np.random.default_rng([SEED, size]).random(size)
        rounded = np.floor((rotated - low[:, None]) / step[:, None] + dither).astype(np.uint8)  # 0 to 15
        f = lambda x: x.astype(np.float32)
        return Codes(f(factor), f(low), f(step), signs, rounded, cell_codes(u, tables, bits).astype("<u4"))

    def pack(self) -> list[bytes]:
        n, size = self.signs.shape
        head = np.zeros(n, HEAD)
        head["factor"], head["low"], head["step"] = self.factor, self.low, self.step
        nibbles = np.pad(self.rounded, ((0, 0), (0, size % 2)))
        both = np.concatenate([head.view(np.uint8).reshape(n, -1), np.packbits(self.signs, axis=1), nibbles[:, ::2] | nibbles[:, 1::2] << 4, self.cells.view(np.uint8).reshape(n, -1)], 1)
        return [row.tobytes() for row in both]

    @staticmethod
    def unpack(data: list[bytes], size: int, tables: int) -> "Codes":
        a = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
        at = np.cumsum([HEAD.itemsize, -(-size // 8), -(-size // 2), 4 * tables])
        head = np.ascontiguousarray(a[:, : at[0]]).view(HEAD)[:, 0]
        nibbles = a[:, at[1] : at[2]]
        rounded = np.stack([nibbles & 15, nibbles >> 4], 2).reshape(len(a), -1)[:, :size]
        return Codes(head["factor"], head["low"], head["step"], np.unpackbits(a[:, at[0] : at[1]], axis=1, count=size).astype(bool), rounded, np.ascontiguousarray(a[:, at[2] : at[3]]).view("<u4"))

    def prepared(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rounded vectors without the dither's mean, signs over the root of the size, and the bounds of the errors."""
        size = self.signs.shape[1]
        dither = np.random.default_rng([SEED, size]).random(size).astype(np.float32)
        about = (self.rounded + np.float32(0.5) - dither) * self.step[:, None] + self.low[:, None]
        codes = np.where(self.signs, np.float32(1), np.float32(-1)) / np.float32(math.sqrt(size))
        factor = np.maximum(self.factor, 1e-12)
        return about, codes, (np.maximum(0, 1 / factor**2 - 1) / max(1, size - 1)).astype(np.float32)

    def first_common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The first table where two points meet."""
        return (self.cells[i] == self.cells[j]).argmax(1)


def estimates(codes: Codes, i: np.ndarray, j: np.ndarray, prepared=None) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of the pairs and the bounds of their errors."""
    about, signs, spread = prepared or codes.prepared()
    factor = np.maximum(codes.factor[j], 1e-12)
    found = np.einsum("ij,ij->i", about[i], signs[j]) / factor
    return found, EPSILON * np.sqrt(spread[j] + codes.step[i] ** 2 / (12 * factor**2))


def near_duplicates(vecs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    value = F.col("embedding").cast("array<double>")
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.forall(value, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)), F.lit(False)) & F.coalesce(F.exists(value, lambda x: x != 0), F.lit(False))
    own = F.transform("embedding", lambda x: x + F.lit(0).cast("tinyint"))  # minus zero becomes zero
    # a vector goes by 128 bits of hashes; the grouping compares the vectors themselves, and two of one hash are an error
    rows = vecs.select("vec_id", usable.alias("usable"), F.xxhash64("label", own).alias("h1"), F.xxhash64(F.lit("second"), own, "label").alias("h2"), "label", own.alias("v"))
    grouped = rows.filter("usable").groupBy("h1", "h2", "label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # numbered when written, so that reading them again gives the same numbers
    points = cut(grouped.select(F.monotonically_increasing_id().alias("pid"), "h1", "h2", F.col("label").cast("string").alias("label"), "v", "least", "copies"), "points")
    largest = points.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    tables, bits = grid(largest, threshold)

    def code():
        def step(b):
            out: list = [None] * len(b["pid"])
            cells: list = [None] * len(b["pid"])
            sizes = [len(v) for v in b["v"]]
            for size in set(sizes):
                at = [i for i, n in enumerate(sizes) if n == size]
                found = Codes.of(unit(np.array([b["v"][i] for i in at], np.float64)), tables, bits)
                for i, data, c in zip(at, found.pack(), found.cells.tolist()):
                    out[i], cells[i] = data, c
            return b | {"size": sizes, "code": out, "cells": cells}

        return step

    kind = points.schema["v"].dataType.simpleString()
    coded = cut(map_rows(points, ["pid", "label", "copies", "v"], f"pid long, label string, copies long, v {kind}, size int, code binary, cells array<long>", code), "codes")
    # a cell's number mixes label, size and code, with the table in its low bits; should two mix alike, the kernels tell them apart
    spread = coded.select("label", "size", "code", F.col("pid").alias("uid"), F.posexplode("cells").alias("table", "own")).select(
        F.shiftleft(F.xxhash64("label", "size", "own"), 6).bitwiseOR(F.col("table").cast("long")).alias("cell"), "uid", "size", "code"
    )
    member = pa.schema([("cell", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("side", pa.int32()), ("uid", pa.int64())])

    def by_codes(t, block, crossing, side):
        """The members that have a pair inside the bound."""
        sizes, data, table = t.column("size").to_numpy(), t.column("code").to_pylist(), t.column("cell").to_numpy() & 63
        wanted = np.zeros(t.num_rows, bool)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            codes = Codes.unpack([data[k] for k in at.tolist()], size, tables)
            prepared, tab = codes.prepared(), table[at]
            for i, j in pairs(block[at], crossing[at], side[at]):
                met = codes.first_common(i, j) == tab[i]
                i, j = i[met], j[met]
                found, bound = estimates(codes, i, j, prepared)
                near = found + bound >= threshold
                wanted[at[i[near]]] = wanted[at[j[near]]] = True
        if wanted.any():
            yield pa.RecordBatch.from_arrays([t.column(f.name).filter(pa.array(wanted)).combine_chunks().cast(f.type) for f in member], schema=member)

    near = run_blocks(sorted_blocks(deal(spread)), "cell long, lo int, hi int, side int, uid long", by_codes)
    met = near.join(coded.select(F.col("pid").alias("uid"), "label", "copies", F.col("v").cast("array<double>").alias("v"), "size", "code"), "uid")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def by_vectors(t, block, crossing, side):
        """Links of the pairs inside the bound, and how many each member has."""
        uid, copies, sizes, cell = (t.column(c).to_numpy() for c in ("uid", "copies", "size", "cell"))
        label = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        data, lists = t.column("code").to_pylist(), t.column("v").combine_chunks()
        flat = lists.values.to_numpy()[lists.offsets[0].as_py() :]
        begins = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
        forest, links = Forest(len(uid)), np.zeros(len(uid), np.int64)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            v = flat[begins[at][:, None] + np.arange(size)]
            u, norms, tab = unit(v), np.linalg.norm(v, axis=1), cell[at] & 63
            plain = np.isfinite(norms**2) & (norms > 1e-100)
            codes = Codes.unpack([data[k] for k in at.tolist()], size, tables)
            prepared = codes.prepared()
            for i, j in pairs(block[at], crossing[at], side[at]):
                ok = (label[at[i]] == label[at[j]]) & (codes.first_common(i, j) == tab[i])
                i, j = i[ok], j[ok]
                found, bound = estimates(codes, i, j, prepared)
                ok = found + bound >= threshold
                i, j = i[ok], j[ok]
                both = plain[i] & plain[j]
                exact = np.where(both, np.einsum("ij,ij->i", v[i], v[j]) / np.where(both, norms[i] * norms[j], 1), np.einsum("ij,ij->i", u[i], u[j]))
                ok = exact >= threshold
                i, j = at[i[ok]], at[j[ok]]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                forest.add(i, j)
        have = np.flatnonzero(links)
        a, b = np.array(forest.links, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[uid[have], uid[a]]), pa.array(np.r_[uid[have], uid[b]]), pa.array(np.r_[links[have], np.zeros(len(a), np.int64)])], schema=schema)

    found = cut(run_blocks(sorted_blocks(met), "a long, b long, links long", by_vectors), "vector-links")
    linked = found.filter("a = b").groupBy(F.col("a").alias("pid")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("a <> b").select("a", "b")).select(F.col("v").alias("pid"), "root")
    rooted = points.select("pid", "h1", "h2", "least", "copies").join(linked, "pid", "left").join(roots, "pid", "left").withColumn("root", F.coalesce("root", "pid"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # complements of hashes: both sides are dealt anew for the join alone, so that Spark may split a large group of copies
    classes = splittable(rooted, least, "root").groupBy(F.bitwise_not("h1").alias("k1"), F.bitwise_not("h2").alias("k2")).agg(
        F.count("*").alias("n"), F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.max("component_id").alias("component_id")
    )
    one = classes.select(
        F.bitwise_not("k1").alias("h1"), F.bitwise_not("k2").alias("h2"), F.when(F.col("n") == 1, F.col("n_links")).otherwise(F.raise_error(F.lit("two vectors share a hash of 128 bits")).cast("long")).alias("n_links"), "component_id"
    )
    joined = rows.filter("usable").select("vec_id", "h1", "h2").join(one, ["h1", "h2"], "left").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    bad = rows.filter(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return joined.unionByName(bad)
