"""Storage as data: runs, their key ranges, levels, overlap, and the decisions of compaction, over manifest frames.

A manifest has a row for each live file: level, idx (place in its level), file_id, first_key, last_key, rows, bytes,
min_op_id, max_op_id. It is small next to the data, but grows with it, so joins on it are left to Spark's measured
sizes, and overlaps are found by a sweep over the sorted ends of the ranges: its running counts tell how many ranges meet
each range, and for pairs which ones, without comparing any two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import encode_size, level_capacity, request_size
from . import oplog
from .versions import latest


def flush_runs(log: DataFrame, run: Column) -> DataFrame:
    """Each run keeps the newest version of each of its keys, tombstones included."""
    return latest(log.withColumn("run_id", run), by=("run_id", "key"))


def run_stats(runs: DataFrame, by: str = "run_id") -> DataFrame:
    """Key range, rows, bytes and id range of each run."""
    return runs.groupBy(by).agg(
        F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("rows"), F.sum(encode_size()).alias("bytes"), F.min("op_id").alias("min_op_id"), F.max("op_id").alias("max_op_id")
    )


def key_range(files: DataFrame) -> DataFrame:
    """One row; raises on no files, whose range would mean nothing."""
    found = files.agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"), F.count("*").alias("n"))
    return found.select(F.when(F.col("n") > 0, F.col("first_key")).otherwise(F.raise_error(F.lit("no files")).cast("string")).alias("first_key"), "last_key")


def _sweep(left: DataFrame, right: DataFrame) -> DataFrame:
    """Starts and ends of all ranges in the order of keys, at equal keys starts first, with how many starts and ends of
    either side have come up to each: side (0 left), file_id, kind (0 start), pos, starts0, ends0, starts1, ends1."""
    ends = None
    for side, files in enumerate((left, right)):
        part = files.select(F.lit(side).alias("side"), "file_id", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("first_key").alias("at")), F.struct(F.lit(1).alias("kind"), F.col("last_key").alias("at")))).alias("e"))
        ends = part if ends is None else ends.unionByName(part)
    placed = oplog.sequence(ends.select("side", "file_id", F.col("e.kind").alias("kind"), F.col("e.at").alias("at")), 0, ["at", "kind", "side", "file_id"], "pos")
    names = [f"{n}{side}" for side in (0, 1) for n in ("starts", "ends")]
    flags = [((F.col("side") == side) & (F.col("kind") == kind)).cast("long").alias(f"{n}{side}") for side in (0, 1) for kind, n in enumerate(("starts", "ends"))]
    flagged = placed.select("side", "file_id", "kind", "pos", *flags)
    return running(flagged, names, "pos")


def running(rows: DataFrame, names: list[str], order: str) -> DataFrame:
    """Running sums of columns in the order of dense or nearly dense numbers, by stretches of these: the sums of the
    stretches before (a row a stretch) plus a sum inside. Other columns stay."""
    inside = Window.partitionBy("_stretch").orderBy(order)
    before = Window.partitionBy(F.lit(0)).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.withColumn("_stretch", F.floor(F.col(order) / STRETCH))
    sums = cut.groupBy("_stretch").agg(*[F.sum(n).alias(f"_{n}") for n in names])
    bases = sums.select("_stretch", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in names])
    summed = cut.select(*[c for c in cut.columns if c not in names], *[F.sum(n).over(inside).alias(n) for n in names])
    return summed.join(bases, "_stretch").select(*[c for c in rows.columns if c not in names], *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in names])


STRETCH = 1 << 16


def _ranges(swept: DataFrame) -> DataFrame:
    """One row per range: side, file_id, pos, and the counts at its start (s) and end (e)."""
    counts = ("starts0", "ends0", "starts1", "ends1")
    at = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return swept.groupBy("side", "file_id").agg(at(0, "pos").alias("pos"), *[at(0, c).alias(f"s_{c}") for c in counts], *[at(1, c).alias(f"e_{c}") for c in counts])


def overlap_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, file_id, n_left, n_right): how many ranges of either side meet each range; its own side's count has itself."""
    met = lambda k: F.col(f"e_starts{k}") - F.col(f"s_ends{k}")  # noqa: E731  begun by its end, less those over before its start
    return _ranges(_sweep(left, right)).select("side", "file_id", met(0).alias("n_left"), met(1).alias("n_right"))


def overlap_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id) of closed ranges that meet: files of each side, with file_id, first_key, last_key. Of two that
    meet, one begins inside the other; the starts of a side are numbered, so a range meets a run of numbers."""
    found = _ranges(_sweep(left, right))
    out = None
    for side, other in ((0, 1), (1, 0)):
        inside = found.filter(F.col("side") == side).select("file_id", F.col(f"s_starts{other}").alias("lo"), F.col(f"e_starts{other}").alias("hi")).filter("hi > lo")
        runs = inside.select("file_id", F.explode(F.sequence(F.col("lo") + 1, "hi")).alias("number"))
        begun = found.filter(F.col("side") == other).select(F.col("file_id").alias("other_id"), F.col(f"s_starts{other}").alias("number"))
        met = runs.join(begun, "number")
        pairs = met.select(F.col("file_id" if side == 0 else "other_id").alias("left_id"), F.col("other_id" if side == 0 else "file_id").alias("right_id"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def overlap_bounds(first, last, files: DataFrame) -> DataFrame:
    """Least and greatest idx of the files that meet [first, last]; a row of nulls for none."""
    return files.filter((F.col("first_key") <= F.lit(last)) & (F.col("last_key") >= F.lit(first))).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))


def split_inputs(inputs: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(inputs to merge, inputs that pass through, targets to merge, targets that stay): an input passes if it meets
    neither a target nor another input."""
    counts = overlap_counts(inputs, targets)
    of = lambda side: counts.filter(F.col("side") == side).select("file_id", "n_left", "n_right")
    i, t = inputs.join(of(0), "file_id"), targets.join(of(1), "file_id")
    alone = (F.col("n_left") == 1) & (F.col("n_right") == 0)
    pick = lambda df, own: df.select(*own.columns)
    return pick(i.filter(~alone), inputs), pick(i.filter(alone), inputs), pick(t.filter("n_left > 0"), targets), pick(t.filter("n_left = 0"), targets)


def delete_changes(files: DataFrame) -> DataFrame:
    """Deletions at the files' places, last place first."""
    return files.select("idx", "file_id", F.lit("Delete").alias("change")).orderBy(F.desc("idx"))


def assemble_level(*parts: DataFrame) -> DataFrame:
    """The files of levels by first key, with their final places."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    placed = oplog.sequence(union, 0, ["level", "first_key", "file_id"], "_at")
    starts = placed.groupBy("level").agg(F.min("_at").alias("_first"))  # a row a level
    return placed.join(F.broadcast(starts), "level").withColumn("idx", (F.col("_at") - F.col("_first")).cast("int")).drop("_at", "_first")


def add_changes(assembled: DataFrame, new: DataFrame) -> DataFrame:
    """Additions of the new files, at their final places."""
    return assembled.join(new.select("file_id"), "file_id", "left_semi").select("idx", "file_id", F.lit("Add").alias("change"))


def level_counts(manifest: DataFrame, depth: int) -> DataFrame:
    """Files of each level, zeros included."""
    levels = manifest.sparkSession.range(depth).select(F.col("id").cast("int").alias("level"))
    return levels.join(manifest.groupBy("level").agg(F.count("*").alias("n_files")), "level", "left").select("level", F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"))


def tables_by_level(manifest: DataFrame) -> DataFrame:
    """The live files of each level, one row each: a level may have any number of them."""
    return manifest.select("level", "file_id")


def totals(manifest: DataFrame) -> DataFrame:
    """One row: files, levels and rows."""
    return manifest.agg(F.count("*").alias("n_files"), (F.max("level") + 1).alias("depth"), F.sum("rows").alias("n_rows"))


def replay(changes: DataFrame) -> DataFrame:
    """(file_id, level) of the live files, from changes (version, change, file_id, level) of all commits. Inside a
    commit deletions come before additions, so that a file it moves lives on at its new level."""
    last = changes.groupBy("file_id").agg(F.max(F.struct("version", (F.col("change") == "Add").alias("live"), "level")).alias("c"))
    return last.filter("c.live").select("file_id", "c.level")


def need_compact(counts: DataFrame, limit: int, ratio: int) -> DataFrame:
    """Levels over their capacity."""
    return counts.withColumn("capacity", level_capacity("level", limit, ratio)).withColumn("over", F.col("n_files") > F.col("capacity"))


def pick(manifest: DataFrame, limit: int, ratio: int) -> DataFrame:
    """Files to compact from levels over capacity: all of level 0, of others the one with the least id."""
    counts = manifest.groupBy("level").agg(F.count("*").alias("n_files"), F.min("file_id").alias("oldest"))
    over = counts.filter(F.col("n_files") > level_capacity("level", limit, ratio))
    return manifest.join(over.select("level", "oldest"), "level").filter((F.col("level") == 0) | (F.col("file_id") == F.col("oldest"))).select(*manifest.columns)


def pick_preview(manifest: DataFrame) -> DataFrame:
    """What each level would give up, whatever its count."""
    oldest = manifest.groupBy("level").agg(F.min("file_id").alias("oldest"))
    return manifest.join(oldest, "level").filter((F.col("level") == 0) | (F.col("file_id") == F.col("oldest"))).select(*manifest.columns)


def prune(files: DataFrame, first, last) -> DataFrame:
    """Files whose range may hold keys of [first, last]: by containment, never by stopping at a later file."""
    return files.filter((F.col("first_key") <= F.lit(last)) & (F.col("last_key") >= F.lit(first)))


def total_sizes(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("n_ops"), F.sum(encode_size()).alias("record_bytes"), F.sum(request_size()).alias("batch_bytes"))


def memtable_bytes(log: DataFrame) -> DataFrame:
    """Bytes written up to each operation."""
    return running(log.select("op_id", encode_size().alias("filled_bytes")), ["filled_bytes"], "op_id")


def memtables(log: DataFrame, limit: int) -> DataFrame:
    """Memtables of a log that is written operation by operation into one that is sealed when it holds ``limit`` bytes:
    memtable (from 0), n_ops, bytes, sealed. Here an operation's memtable is told by the bytes before it, so that one is
    sealed by the operation that reaches a multiple of ``limit``."""
    sized = memtable_bytes(log).join(log.select("op_id", encode_size().alias("size")), "op_id")
    of = F.floor((F.col("filled_bytes") - F.col("size")) / limit).cast("long")
    found = sized.groupBy(of.alias("memtable")).agg(F.count("*").alias("n_ops"), F.sum("size").alias("bytes"), F.max("filled_bytes").alias("_filled"))
    return found.select("memtable", "n_ops", "bytes", (F.col("_filled") >= (F.col("memtable") + 1) * limit).alias("sealed"))
