"""Registered queries that go through a persistent store, its memtables, compaction, streams and binary formats.

Each builds a store of the whole log in the folder that driver and executors share, works on it, and reads it back; the
SQL says what must come out. Values are the operations' ids as text, as engines write floats differently.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, LevelConfig, StorageConfig, TableConfig
from ..operators import oplog, versions
from ..sources import wire
from ..store import Store
from ..streaming.ingest import ingest, latest_view
from .queries import LOGS, _latest, _probe_keys, _texts, half, log_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PARTS = 4  # batches that a log comes in
MICRO_BATCHES, FILES = 3, 8  # of a log that is streamed, and of each of them: tasks write and read these side by side
SMALL = Config(lsm_storage_config=StorageConfig(1 << 15, LevelConfig(2, 2, TableConfig(64))))


def query(name: str, sql: str | None, run: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def work_folder(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``, or, on a single machine that names none, a temporary one. It is deleted
    when the driver's JVM ends."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), f"tidelog-{os.getpid()}")
    path = f"{found.rstrip('/')}/store-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def binary(log: DataFrame) -> DataFrame:
    """The log as a store keeps it."""
    return _texts(log).select("op_id", F.col("key").cast("binary").alias("key"), "op", F.col("value").cast("binary").alias("value"))


def plain(rows: DataFrame) -> DataFrame:
    """Keys and values as text again."""
    return rows.select(*[F.col(c).cast("string").alias(c) if c in ("key", "value", "first_key", "last_key") else F.col(c) for c in rows.columns])


def store_of(spark: SparkSession, sf_dir: str, memtable: bool = False, compact: bool = True, name: str = "events") -> Store:
    """The whole log, in ``PARTS`` batches by id, with compactions between them; the last batch stays where it came. The
    table is read once and kept by the executors until the last batch is in, as each batch is looked at to be dealt."""
    log = binary(log_of(spark, sf_dir, name)).persist()
    try:
        most = log.agg(F.max("op_id")).first()[0] or 0
        store = Store(spark, work_folder(spark), SMALL)
        step = most // PARTS + 1
        for k in range(PARTS):
            store.append_ops(log.filter((F.col("op_id") >= k * step) & (F.col("op_id") < (k + 1) * step)), memtable)
            if compact and k < PARTS - 1:
                store.maintain()
        return store
    finally:
        log.unpersist()


LOG = {n: sql.replace("NULL ELSE value END AS value", "NULL ELSE 'v' || CAST(event_id AS VARCHAR) END AS value").replace("NULL ELSE o_totalprice END AS value", "NULL ELSE 'v' || CAST(o_orderkey AS VARCHAR) END AS value") for n, sql in LOGS.items()}


def _sql(where: str = "true", keep: str = "rn = 1 AND op = 'W'", columns: str = "key, op_id, value", log: str = "events") -> str:
    return _latest(where, log, keep, columns).replace(LOGS[log], LOG[log])


HALF = "(SELECT max(op_id) // 2 FROM log)"

query("store_snapshot", _sql(), lambda s, d: plain(store_of(s, d).reader().snapshot()).select("key", "op_id", "value"))
query("store_snapshot_orders", _sql(log="orders"), lambda s, d: plain(store_of(s, d, name="orders").reader().snapshot()).select("key", "op_id", "value"))
query("store_memtable_snapshot", _sql(), lambda s, d: plain(store_of(s, d, memtable=True).reader().snapshot()).select("key", "op_id", "value"))


def _as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = store_of(spark, sf_dir)
    return plain(store.reader((store.current_op_id() - 1) // 2).snapshot()).select("key", "op_id", "value")


query("store_time_travel", _sql(f"op_id <= {HALF}"), _as_of)
query("store_range_scan", _sql("key >= '000010' AND key < '000060'"), lambda s, d: plain(store_of(s, d).reader().range_scan(b"000010", b"000060")).select("key", "op_id", "value"))
query("store_multi_get", _sql("key IN (SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') FROM customer)"), lambda s, d: plain(store_of(s, d).reader().multi_get(_probe_keys(s, d).select(F.col("key").cast("binary").alias("key")))).select("key", "op_id", "value"))


def _get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read by key through the layers, of the least live key."""
    reader = store_of(spark, sf_dir).reader()
    key = bytes(reader.snapshot().agg(F.min("key")).first()[0])
    return spark.createDataFrame([(key.decode(), reader.get(key).decode(), reader.get(b"none") is None)], "key string, value string, none_missing boolean")


query("store_get", f"SELECT key, value, true AS none_missing FROM ({_sql()}) ORDER BY key LIMIT 1", _get)


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("probe_id"), F.when(F.col("event_id") % 50 != 0, F.lpad(F.col("user_id").cast("string"), 6, "0").cast("binary")).alias("key"), F.when(F.col("event_id") % 70 != 0, F.floor(F.col("event_id") / 2) + 3).alias("as_of"))
    return plain(store_of(spark, sf_dir).reader().as_of_join(probes)).select("probe_id", "key", "as_of", "op_id", "value")


query(
    "store_as_of_join",
    f"""WITH log AS ({LOG['events']}), p AS (SELECT event_id AS probe_id, CASE WHEN event_id % 50 <> 0 THEN lpad(CAST(user_id AS VARCHAR), 6, '0') END AS key, CASE WHEN event_id % 70 <> 0 THEN event_id // 2 + 3 END AS as_of FROM events),
    j AS (SELECT p.probe_id, p.key, p.as_of, l.op_id, l.op, l.value FROM p ASOF LEFT JOIN log l ON p.key = l.key AND p.as_of >= l.op_id)
    SELECT probe_id, key, as_of, CASE WHEN op = 'W' THEN op_id END AS op_id, CASE WHEN op = 'W' THEN value END AS value FROM j""",
    _probes,
)


def _collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files hold after a compaction that keeps no history, whatever level they came to: all batches meet."""
    store = store_of(spark, sf_dir, compact=False)
    store.compact(collapse=True)
    return plain(store.reader().log().filter("op = 'W'")).select("key", "op_id", "value")


query("store_collapse", _sql(), _collapsed)


def _retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads from the horizon on answer as before a compaction that drops what no such read sees."""
    store = store_of(spark, sf_dir, compact=False)
    horizon = (store.current_op_id() - 1) // 2
    store.compact(retain_from=horizon)
    return plain(store.reader(horizon).snapshot()).select("key", "op_id", "value")


query("store_retention", _sql(f"op_id <= {HALF}"), _retained)
query("store_history", f"SELECT key, op_id, op, value FROM ({LOG['events']})", lambda s, d: plain(store_of(s, d).reader().log()).select("key", "op_id", "op", "value"))
query("store_reopen", _sql(), lambda s, d: plain(Store(s, store_of(s, d, memtable=True).path).reader().snapshot()).select("key", "op_id", "value"))


def _sequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches without ids, one after another: writes, then deletes; each in the order of its old ids."""
    log = binary(log_of(spark, sf_dir)).withColumnRenamed("op_id", "old_id")
    store = Store(spark, work_folder(spark), SMALL)
    for op in ("W", "D"):
        store.write_batch(log.filter(F.col("op") == op), ["old_id"])
    return plain(store.reader().log()).select("key", "op_id", "op", "value")


query("store_write_batch", f"SELECT key, row_number() OVER (ORDER BY CASE WHEN op = 'W' THEN 0 ELSE 1 END, op_id) - 1 AS op_id, op, value FROM ({LOG['events']})", _sequenced)


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations, bytes and ids that the manifest tells of, and whether any level is over its capacity."""
    store = store_of(spark, sf_dir)
    store.maintain()
    over = store.need_compact()
    return store.describe().agg(F.sum("rows").alias("n_ops"), F.sum("bytes").alias("record_bytes"), F.min("min_op_id").alias("first_id"), F.max("max_op_id").alias("last_id")).withColumn("over", F.lit(over))


_SIZES = f"SELECT op_id, key, op, value, 17 + strlen(key) + CASE WHEN op = 'W' THEN 8 + strlen(value) ELSE 0 END AS size FROM ({LOG['events']})"
query("store_totals", f"SELECT count(*) AS n_ops, CAST(sum(size) AS BIGINT) AS record_bytes, min(op_id) AS first_id, max(op_id) AS last_id, false AS over FROM ({_SIZES})", _totals)


def _flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in memtables and below before sealing, after it, and after the flush that ignores the gate."""
    store = store_of(spark, sf_dir, memtable=True, compact=False)
    rows = []
    for step, act in enumerate((lambda: None, store.freeze, lambda: store.flush(gate=False))):
        act()
        state = store.state()
        rows.append((step, sum(f.bytes for f in state.files), sum(f.bytes for f in state.levels[0]) > 0, len(state.sealed) > 0))
    return spark.createDataFrame(rows, "step int, bytes long, in_level_zero boolean, waiting boolean")


query("store_flush", f"WITH t AS (SELECT CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n FROM ({_SIZES})) SELECT CAST(step AS INTEGER) AS step, bytes, step = 2 AS in_level_zero, step = 1 OR (step = 0 AND bytes >= {PARTS} * {1 << 15}) AS waiting FROM t, range(3) r(step)", _flushed)


def _streamed(spark: SparkSession, sf_dir: str) -> Store:
    """The log as a stream of files, ``FILES`` of them a micro-batch, each micro-batch one commit."""
    work = work_folder(spark)
    log = binary(log_of(spark, sf_dir))
    log.repartitionByRange(MICRO_BATCHES * FILES, "op_id").sortWithinPartitions("op_id").write.parquet(f"{work}/in")
    stream = spark.readStream.schema(oplog.SCHEMA).option("maxFilesPerTrigger", FILES).parquet(f"{work}/in")
    store = Store(spark, f"{work}/store", SMALL)
    ingest(store, stream, f"{work}/checkpoint", "files", ["op_id"]).awaitTermination()
    return store


query("stream_ingest_totals", f"SELECT op, count(*) AS n, count(DISTINCT key) AS n_keys FROM ({LOG['events']}) GROUP BY op", lambda s, d: _streamed(s, d).reader().log().groupBy("op").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys")))


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of each key as streaming state."""
    work, name = work_folder(spark), f"view_{uuid.uuid4().hex}"
    binary(log_of(spark, sf_dir)).repartition(3).write.parquet(f"{work}/in")
    stream = spark.readStream.schema(oplog.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{work}/in")
    latest_view(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return plain(spark.table(name)).select("key", "op_id", "op", "value")


query("stream_latest_view", _sql(keep="rn = 1", columns="key, op_id, op, value"), _view)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each operation's size in the binary format."""
    return wire.encoded(binary(log_of(spark, sf_dir))).select("op_id", F.octet_length("record").cast("long").alias("size"))


query("record_sizes", f"SELECT op_id, CAST(size AS BIGINT) AS size FROM ({_SIZES})", _records)


def _wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region table as a log: a write-ahead file a batch, the last one cut off in its last record."""
    from ..sources.files import Files

    rows = [(r.r_regionkey, r.r_name.encode(), "D" if r.r_regionkey == 2 else "W", None if r.r_regionkey == 2 else b"x") for r in spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect()]  # five rows
    files = Files(spark, work_folder(spark))
    wire.append_wal(files, "wal", rows[:3])
    name = wire.append_wal(files, "wal", rows[3:])
    files.replace(name, files.read(name)[:-1])
    return plain(wire.read_wal(spark, f"{files.root}/wal/*.wal")).select("op_id", "key", "op", "value")


query("wal_scan", "SELECT CAST(r_regionkey AS BIGINT) AS op_id, r_name AS key, CASE WHEN r_regionkey = 2 THEN 'D' ELSE 'W' END AS op, CASE WHEN r_regionkey = 2 THEN NULL ELSE 'x' END AS value FROM regions WHERE r_regionkey < (SELECT max(r_regionkey) FROM regions)".replace("regions", "region"), _wal)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted log in blocks: what all blocks hold, and the keys they begin and end with."""
    log = binary(log_of(spark, sf_dir)).repartitionByRange("key", "op_id").sortWithinPartitions("key", "op_id")
    return plain(wire.block_stats(log).agg(F.sum("n_records").alias("n_records"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key")))


query("block_scan", f"SELECT count(*) AS n_records, min(key) AS first_key, max(key) AS last_key FROM ({LOG['events']})", _blocks)


def _manifest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation table as changes, a batch a region, odd ones deletions of inputs: written framed, with checksums, and read back."""
    from ..sources.files import Files

    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()  # 25 rows
    batches = []
    for region in sorted({r.n_regionkey for r in nations}):
        own = [r.n_nationkey for r in nations if r.n_regionkey == region]
        batches.append(wire.Changes(region, tuple(wire.Change(k, k + 100, "Delete") for k in own if k % 2), tuple(wire.Change(k, k + 100, "Add") for k in own if k % 2 == 0)))
    files = Files(spark, work_folder(spark))
    files.replace("manifest.bin", b"".join(wire.frame(b.encode()) for b in batches))
    read = [wire.Changes.decode(p) for p in wire.frames(files.read("manifest.bin"))]
    rows = [(b.input_level, part, c.index, c.id, c.change) for b in read for part, cs in (("inputs", b.inputs), ("targets", b.targets)) for c in cs]
    return spark.createDataFrame(rows, "input_level long, part string, idx long, file_id long, change string")


query(
    "manifest_log",
    "SELECT CAST(n_regionkey AS BIGINT) AS input_level, CASE WHEN n_nationkey % 2 = 1 THEN 'inputs' ELSE 'targets' END AS part, CAST(n_nationkey AS BIGINT) AS idx, CAST(n_nationkey + 100 AS BIGINT) AS file_id, CASE WHEN n_nationkey % 2 = 1 THEN 'Delete' ELSE 'Add' END AS change FROM nation",
    _manifest_log,
)


def _table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation table's keys, filled into a table of five blocks that hold four records each, and what their encoded
    key ranges and their records say."""
    keys = [f"{r.n_nationkey:06d}".encode() for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()]  # 25 rows
    size = 4 * len(wire.encode_record(0, keys[0], "W", b"x")) + wire.BLOCK_TRAILER
    blocks, metas, _ = wire.fill_table([(k, key, "W", b"x") for k, key in enumerate(keys)], 5, size)
    ranges = [wire.decode_block_meta(m)[0] for m in metas]
    rows = [(k, first.decode(), last.decode(), wire.first_key(b) == first, sum(1 for _ in wire.read_block(b))) for k, (b, (first, last)) in enumerate(zip(blocks, ranges))]
    return spark.createDataFrame(rows, "block long, first_key string, last_key string, begins_so boolean, n_records long")


query(
    "table_blocks",
    "WITH r AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS key, row_number() OVER (ORDER BY n_nationkey) - 1 AS n FROM nation) SELECT CAST(n // 4 AS BIGINT) AS block, min(key) AS first_key, max(key) AS last_key, true AS begins_so, count(*) AS n_records FROM r WHERE n < 20 GROUP BY n // 4",
    _table_blocks,
)


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings that a store wrote, as it reads them when it is opened again."""
    config = Store(spark, Store(spark, work_folder(spark), SMALL).path).config
    s = config.lsm_storage_config
    level = s.level_config
    rows = [("memtable_size_limit", s.memtable_size_limit), ("level_zero_num_limit", level.level_zero_num_limit), ("level_ratio", level.level_ratio), ("block_num_limit", level.table_config.block_num_limit), ("imm_num_limit", config.imm_num_limit)]
    return spark.createDataFrame(rows, "name string, value long")


query("store_settings", "SELECT name, CAST(value AS BIGINT) AS value FROM (VALUES ('memtable_size_limit', 32768), ('level_zero_num_limit', 2), ('level_ratio', 2), ('block_num_limit', 64), ('imm_num_limit', 2)) v(name, value)", _settings)
