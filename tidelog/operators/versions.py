"""Reads: the latest visible version of each key as of an operation id.

Everything is one plan: bound the ids, keep the greatest id of each key, then drop tombstones. The bound stands below
the aggregate and the tombstone filter above it, as the semantics demand. The per-key maximum of a struct led by the
id combines before the shuffle, so a hot key sends one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import DELETE, WRITE

STRETCH = 1 << 20  # ids of a stretch, and rows that a group of keys is swept with whole
GROUPS = 1 << 16  # groups of keys, by their hash
BLIND = 4096  # stretches for probes that cannot see anything


def as_of(log: DataFrame, horizon: int | Column | None) -> DataFrame:
    """horizon: an id, or a column of one value such as a scalar subquery."""
    return log if horizon is None else log.filter(F.col("op_id") <= horizon)


def latest(log: DataFrame, horizon: int | Column | None = None, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """The newest version of each key, tombstones included."""
    rest = [c for c in log.columns if c not in (*by, "op_id")]
    newest = as_of(log, horizon).groupBy(*by).agg(F.max(F.struct("op_id", *rest)).alias("v"))
    return newest.select(*[F.col(c) if c in by else F.col(f"v.{c}").alias(c) for c in log.columns])


def live(versions: DataFrame) -> DataFrame:
    return versions.filter(F.col("op") == WRITE).drop("op")


def snapshot(log: DataFrame, horizon: int | Column | None = None) -> DataFrame:
    return live(latest(log, horizon))


def get(log: DataFrame, key, horizon: int | Column | None = None) -> DataFrame:
    """Point read: the key filter reaches the scan."""
    return snapshot(log.filter(F.col("key") == F.lit(key)), horizon)


def multi_get(log: DataFrame, keys: DataFrame, horizon: int | Column | None = None) -> DataFrame:
    """Batched point reads; ``keys`` has a column ``key``. Spark picks the join by the measured size of the keys."""
    return snapshot(log.join(keys.select("key").distinct(), "key", "left_semi"), horizon)


def range_scan(log: DataFrame, start, end, horizon: int | Column | None = None) -> DataFrame:
    """Keys in [start, end); None leaves a side open."""
    if start is not None:
        log = log.filter(F.col("key") >= F.lit(start))
    if end is not None:
        log = log.filter(F.col("key") < F.lit(end))
    return snapshot(log, horizon)


def deleted_keys(log: DataFrame, horizon: int | Column | None = None) -> DataFrame:
    return latest(log, horizon).filter(F.col("op") == DELETE).select("key", "op_id")


def history(log: DataFrame, key: Column | None = None) -> DataFrame:
    """All versions, in the order the log is kept in."""
    found = log if key is None else log.filter(F.col("key") == key)
    return found.orderBy("key", "op_id")


def as_of_join(probes: DataFrame, log: DataFrame) -> DataFrame:
    """For each probe (probe_id, key, as_of) the version visible to it; probes that see none, or a tombstone, get nulls,
    and so do probes without key or as_of.

    A union of both sides is swept in the order of ids inside each key, so nothing is multiplied: each probe takes the
    last version before it. Rows are counted first by groups of keys: the keys of a group of more than ``STRETCH`` rows are
    divided into stretches of ids, so that a hot key is swept by many tasks, and each stretch starts from the newest version
    of the stretches before it; all others are swept whole. The groups that are divided, ``GROUPS`` at most, are broadcast.
    Probes without key or as_of see nothing, so they are dealt by their ids into stretches below all others, however many
    they are.
    """
    blind = F.col("key").isNull() | F.col("at").isNull()
    stretch = F.when(blind, -1 - F.pmod(F.xxhash64("probe_id"), F.lit(BLIND))).when(F.col("hot").isNotNull(), F.floor(F.col("at") / STRETCH)).otherwise(0)
    version = F.struct("op_id", "op", "value")
    rows = log.select("key", F.col("op_id").alias("at"), F.lit(0).alias("kind"), version.alias("v"), F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"))
    asked = probes.select("key", F.col("as_of").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(rows.schema["v"].dataType).alias("v"), "probe_id")
    both = rows.unionByName(asked)
    group = F.xxhash64("key").bitwiseAND(GROUPS - 1)
    hot = both.filter(~blind).groupBy(group.alias("hot")).agg(F.count("*").alias("n")).filter(F.col("n") > STRETCH).select("hot")
    both = both.join(F.broadcast(hot), group == F.col("hot"), "left").withColumn("stretch", stretch)
    inside = Window.partitionBy("key", "stretch").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("seen", F.last("v", ignorenulls=True).over(inside)).filter("kind = 1")
    ends = both.filter("hot IS NOT NULL").groupBy("key", "stretch").agg(F.max(F.when(F.col("kind") == 0, F.struct("at", "v"))).alias("e"))
    carried = ends.withColumn("before", F.last(F.col("e.v"), ignorenulls=True).over(Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)))
    carried = carried.filter("before IS NOT NULL").select(F.col("key").alias("k"), F.col("stretch").alias("of"), "before")
    seen = swept.join(carried, (F.col("key") == F.col("k")) & (F.col("stretch") == F.col("of")), "left")
    seen = seen.withColumn("s", F.when(F.col("at").isNotNull(), F.coalesce("seen", "before")))
    hit = F.col("s.op") == WRITE
    return seen.select("probe_id", "key", F.col("at").alias("as_of"), F.when(hit, F.col("s.op_id")).alias("op_id"), F.when(hit, F.col("s.value")).alias("value"))


def merge_runs(runs: list[DataFrame], drop_tombstones: bool = False) -> DataFrame:
    """Sorted runs to one: the newest version of each key over all runs; duplicates inside a run are no matter."""
    union = runs[0]
    for r in runs[1:]:
        union = union.unionByName(r)
    return latest(union).filter(F.col("op") == WRITE) if drop_tombstones else latest(union)
