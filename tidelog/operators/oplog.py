"""The operation log: one row per write or delete, each with a unique id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from ..functions.scalars import DELETE, WRITE, padded

SCHEMA = T.StructType(
    [
        T.StructField("op_id", T.LongType(), False),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)


def oplog(df: DataFrame, op_id: Column | str, key: Column | str, deleted: Column, value: Column | str) -> DataFrame:
    """A log view of any table. A delete has no value; an empty value is a write."""
    name = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(name(op_id).alias("op_id"), name(key).alias("key"), F.when(deleted, DELETE).otherwise(WRITE).alias("op"), F.when(~deleted, name(value)).alias("value"))


def checked(log: DataFrame) -> DataFrame:
    """Raises, when run, on unknown operations, keyless rows, deletes with a value and writes without one."""
    bad = ~F.col("op").isin(WRITE, DELETE) | F.col("key").isNull() | F.col("op_id").isNull() | ((F.col("op") == WRITE) != F.col("value").isNotNull())
    return log.withColumn("op", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("malformed operation")).cast("string")).otherwise(F.col("op")))


def duplicate_ids(log: DataFrame) -> DataFrame:
    """Ids that occur more than once; a valid log has none."""
    return log.groupBy("op_id").agg(F.count("*").alias("n")).filter("n > 1")


def from_events(events: DataFrame) -> DataFrame:
    return oplog(events, "event_id", padded("user_id"), F.col("event_type") == "error", "value")


def from_orders(orders: DataFrame) -> DataFrame:
    return oplog(orders, "o_orderkey", padded("o_custkey"), F.col("o_orderstatus") == "F", "o_totalprice")


def sequence(batch: DataFrame, first_id: int, order: list[str], name: str = "op_id") -> DataFrame:
    """Dense consecutive ids in the order given. Rows are dealt and sorted by ranges once and kept on the executors' disks
    with their place in their range, as a second dealing might cut the ranges elsewhere; a lost executor's ranges are dealt
    again as they were. The ranges are counted, and each row adds what the ranges before its own hold. The counts have one
    row a range, so they are broadcast. Release the result's cache with ``spark.catalog.clearCache`` or ``unpersist``."""
    place = F.monotonically_increasing_id()  # range number and place in it
    dealt = batch.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place).persist(StorageLevel.DISK_ONLY)
    part = F.shiftright("_place", 33)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = dealt.withColumn("_part", part).join(F.broadcast(before), "_part")
    out = numbered.select(*[F.col(f"`{c}`") for c in batch.columns], (F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + first_id).alias(name))
    out._cached = dealt
    return out
