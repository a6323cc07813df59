"""Connected components of a distributed graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove


def splittable(rows: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Joins rows with one row a key, by the complement of a long key: neither side is dealt by it already, so both
    are dealt for this join alone and Spark may split the partition of a hot key."""
    once = totals.select(F.bitwise_not(key).alias("_key"), *[c for c in totals.columns if c != key])
    return rows.withColumn("_key", F.bitwise_not(key)).join(once, "_key").drop("_key")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: (a long, b long). Returns (v, root): each vertex that is not the least of its component, with the
    least. Every round is two joins on vertices whose hot side Spark may split, and is written to the shared
    folder, so nothing of the graph reaches the driver but two sums that tell whether a round changed anything."""
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        # large star: every neighbour above a vertex is tied to the least of its neighbourhood
        both = now.select(F.col("v").alias("u"), F.col("root").alias("w")).unionAll(now.select(F.col("root").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = splittable(both, least, "u").filter("w > u").select(F.col("w").alias("v"), F.col("m").alias("root")).distinct()
        # small star: a vertex and those below it are tied to the least below it
        least = large.groupBy("v").agg(F.min("root").alias("m"))
        small = splittable(large, least, "v").filter("root <> m").select(F.col("root").alias("v"), F.col("m").alias("root"))
        now, old = cut(small.unionAll(least.select("v", F.col("m").alias("root"))).distinct(), "edges"), now
        remove(old)
        after = now.agg(F.count("*"), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)"))).first()
        if after == before:
            return now
        before = after
    raise RuntimeError(f"no end after {most_rounds} rounds")
