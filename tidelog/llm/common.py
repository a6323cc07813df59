"""Shared helpers: tables, Arrow mapping, lineage cutting and hashing of words."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where the session names none, a temporary one on a
    single machine (tests) and an error on a cluster, whose machines would not see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), f"tidelog-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors
    cost a reread only. Shuffle files behind it are then garbage, so their collection is asked for. The files
    are deleted by ``remove``, by the ``Scratch`` they are made in, or when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    folder, fs = _folder(spark, path)
    fs.deleteOnExit(folder)
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._cut_path = path
    for open_scratch in _open:
        open_scratch.paths.append(path)
    return out


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(df: DataFrame) -> None:
    """Delete the files of a frame that ``cut`` returned, if it did; nothing may read it any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        folder, fs = _folder(df.sparkSession, path)
        fs.delete(folder, True)


_open: list["Scratch"] = []


class Scratch:
    """``with Scratch(spark) as s``: what is cut inside is deleted at its end, but for the frames ``s.keep`` was given."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df._cut_path)
        return df

    def __enter__(self) -> "Scratch":
        _open.append(self)
        return self

    def __exit__(self, *_) -> None:
        _open.remove(self)
        for path in self.paths:
            if path not in self.kept:
                folder, fs = _folder(self.spark, path)
                fs.delete(folder, True)


def map_rows(df: DataFrame, columns: list, schema: str, make: Callable) -> DataFrame:
    """``make()`` runs once in a task and returns a function from a dict of input columns to a dict
    of output columns, called for each Arrow batch."""
    ship(df.sparkSession)
    out = _parse_datatype_string(schema)
    assert isinstance(out, StructType)
    names, arrow = out.fieldNames(), to_arrow_schema(out)

    def run(batches):
        step = make()
        for batch in batches:
            got = step(batch.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(got[n], arrow.field(n).type) for n in names], schema=arrow)

    return df.select(*columns).mapInArrow(run, out)


def whole_text(column: str = "text"):
    """Null texts count as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 5 == 0


SAMPLE_BYTES = 16 << 20  # of text in a sample that a model is fitted on


def labelled_sample(spark: SparkSession, docs: DataFrame, sf_dir: str, label: str, rows: int, most: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold, in the order of the ids' hashes, as long as their
    texts together take at most ``most`` bytes (one that would pass this is left out, later ones may fit): (doc_id, text,
    label), one row for an id. A bounded sample for fitting only. The lists of ids are bounded by ``rows``, hence the
    broadcasts; of rows that repeat an id the least text counts, of labels that do the greatest."""
    labels = table(spark, sf_dir, "labels").filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    picked = labels.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(picked), "doc_id")
    sample = cut(found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label"), "sample")
    sizes = sample.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).collect()
    if sum(r.n for r in sizes) <= most:
        return sample
    ids, total = [], 0
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
        if total + r.n <= most:
            ids.append((r.doc_id,))
            total += r.n
    return sample.join(F.broadcast(spark.createDataFrame(ids, "doc_id long")), "doc_id", "left_semi")


class Memo(dict):
    """A cache of bounded bytes: ``memo[key]`` computes what it lacks. When full, only what was used since it was
    last full is kept, so that common keys stay. Keys and values are strings, bytes, numbers, lists or tuples of numbers."""

    def __init__(self, make: Callable, most: int = 96 << 20):
        super().__init__()
        self.make, self.most, self.old, self.size = make, most // 2, {}, 0

    @staticmethod
    def _bytes(x) -> int:
        return getsizeof(x) + (32 * len(x) if isinstance(x, (list, tuple)) else 0)

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        size = 100 + self._bytes(key) + self._bytes(value)
        if size > self.most // 8:  # would push out everything else
            return value
        if self.size + size > self.most:
            self.old = dict(self)
            self.clear()
            self.size = 0
        self[key] = value
        self.size += size
        return value
