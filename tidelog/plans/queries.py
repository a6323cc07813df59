"""Registered queries over the driver tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import oplog, storage, versions

LOGS = {
    "events": "SELECT event_id AS op_id, lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, CASE WHEN event_type = 'error' THEN 'D' ELSE 'W' END AS op, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events",
    "orders": "SELECT o_orderkey AS op_id, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS key, CASE WHEN o_orderstatus = 'F' THEN 'D' ELSE 'W' END AS op, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS value FROM orders",
}
RUN, LIMIT, RATIO = 1000, 2, 2
HALF = "(SELECT max(op_id) // 2 FROM log)"  # the horizon of reads as of an id: half of all ids


def log_of(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return {"events": oplog.from_events, "orders": oplog.from_orders}[name](table)


def half(log: DataFrame) -> Column:
    """Half of the greatest id, as a scalar subquery."""
    return F.floor(log.agg(F.max("op_id")).scalar() / 2)


def _latest(where: str = "true", log: str = "events", keep: str = "rn = 1", columns: str = "key, op_id, op, value", by: str = "key") -> str:
    return f"WITH log AS ({LOGS[log]}) SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY op_id DESC) AS rn FROM log WHERE {where}) WHERE {keep}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None, run: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


LIVE = "rn = 1 AND op = 'W'"
KV = "key, op_id, value"

for _log in LOGS:
    _s = "" if _log == "events" else f"_{_log}"
    query(f"latest_with_tombstones{_s}", _latest(log=_log), lambda s, d, n=_log: versions.latest(log_of(s, d, n)))
    query(f"snapshot_scan{_s}", _latest(log=_log, keep=LIVE, columns=KV), lambda s, d, n=_log: versions.snapshot(log_of(s, d, n)))
    query(f"snapshot_as_of{_s}", _latest(f"op_id <= {HALF}", _log, LIVE, KV), lambda s, d, n=_log: versions.snapshot(log_of(s, d, n), half(log_of(s, d, n))))
    query(f"deleted_keys{_s}", _latest(log=_log, keep="rn = 1 AND op = 'D'", columns="key, op_id"), lambda s, d, n=_log: versions.deleted_keys(log_of(s, d, n)))
    query(f"live_key_count{_s}", f"SELECT count(*) AS n_keys FROM ({_latest(log=_log, keep=LIVE)})", lambda s, d, n=_log: versions.snapshot(log_of(s, d, n)).agg(F.count("*").alias("n_keys")))
    query(f"range_scan{_s}", _latest("key >= '000003' AND key < '000100'", _log, LIVE, KV), lambda s, d, n=_log: versions.range_scan(log_of(s, d, n), "000003", "000100"))
    query(f"encode_size_total{_s}", f"WITH log AS (SELECT op_id, key, op, CASE WHEN op = 'W' THEN 'v' || CAST(op_id AS VARCHAR) END AS v FROM ({LOGS[_log]})) SELECT count(*) AS n_ops, CAST(sum(17 + strlen(key) + CASE WHEN op = 'W' THEN 8 + strlen(v) ELSE 0 END) AS BIGINT) AS record_bytes, CAST(sum(9 + strlen(key) + CASE WHEN op = 'W' THEN 8 + strlen(v) ELSE 0 END) AS BIGINT) AS batch_bytes FROM log", lambda s, d, n=_log: storage.total_sizes(_texts(log_of(s, d, n))))
    query(f"version_history{_s}", f"WITH log AS ({LOGS[_log]}) SELECT key, op_id, op, value FROM log ORDER BY key, op_id", lambda s, d, n=_log: versions.history(log_of(s, d, n)).select("key", "op_id", "op", "value"))
    query(f"merge_runs{_s}", _latest(log=_log), lambda s, d, n=_log: versions.merge_runs([storage.flush_runs(log_of(s, d, n).filter(F.floor(F.col("op_id") / RUN) % 4 == k), F.floor(F.col("op_id") / RUN)).drop("run_id") for k in range(4)]))
    query(f"compact_deepest{_s}", _latest(log=_log, keep=LIVE), lambda s, d, n=_log: versions.merge_runs([versions.latest(log_of(s, d, n).filter(F.col("op_id") % 3 == k)) for k in range(3)], drop_tombstones=True))
    query(f"flush_runs{_s}", _latest(log=_log, columns="run_id, key, op_id, op, value", by="op_id // 1000, key").replace("SELECT *, row_number()", "SELECT *, op_id // 1000 AS run_id, row_number()"), lambda s, d, n=_log: storage.flush_runs(log_of(s, d, n), F.floor(F.col("op_id") / RUN)).select("run_id", "key", "op_id", "op", "value"))


def _texts(log: DataFrame) -> DataFrame:
    """Values as integer text: engines write floats differently."""
    return log.withColumn("value", F.when(F.col("op") == X.WRITE, F.concat(F.lit("v"), F.col("op_id").cast("string"))))


def _key_of(op: str) -> str:
    return f"(SELECT min(key) FROM ({_latest(keep=f'rn = 1 AND op = {op!r}')}))"


def _point(op: str):
    """Reads the first key that is live, or deleted, at the end."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = log_of(spark, sf_dir)
        return versions.get(log, versions.latest(log).filter(F.col("op") == op).agg(F.min("key")).scalar())

    return run


query("point_get", _latest(f"key = {_key_of('W')}", keep=LIVE, columns=KV), _point("W"))
query("point_get_deleted", _latest(f"key = {_key_of('D')}", keep=LIVE, columns=KV), _point("D"))
query("point_get_missing", _latest("key = 'no such key'", keep=LIVE, columns=KV), lambda s, d: versions.get(log_of(s, d), "no such key"))
_HALF_KEY = f"(SELECT min(key) FROM ({_latest(f'op_id <= {HALF}', keep=LIVE)}))"
query("point_get_as_of", _latest(f"key = {_HALF_KEY} AND op_id <= {HALF}", keep=LIVE, columns=KV), lambda s, d: _first_as_of(log_of(s, d)))


def _first_as_of(log: DataFrame) -> DataFrame:
    """Reads the first key that is live as of half of all ids, as of then."""
    return versions.get(log, versions.snapshot(log, half(log)).agg(F.min("key")).scalar(), half(log))


def _probe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(X.padded("c_custkey").alias("key"))


query("multi_get", _latest("key IN (SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') FROM customer)", keep=LIVE, columns=KV), lambda s, d: versions.multi_get(log_of(s, d), _probe_keys(s, d)))


def _as_of_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("probe_id"), X.padded("user_id").alias("key"), (F.floor(F.col("event_id") / 2) + 3).alias("as_of"))
    return versions.as_of_join(probes, log_of(spark, sf_dir))


query(
    "as_of_probe_join",
    f"""WITH log AS ({LOGS['events']}), p AS (SELECT event_id AS probe_id, lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, event_id // 2 + 3 AS as_of FROM events),
    j AS (SELECT p.probe_id, p.key, p.as_of, l.op_id, l.op, l.value FROM p ASOF LEFT JOIN log l ON p.key = l.key AND p.as_of >= l.op_id)
    SELECT probe_id, key, as_of, CASE WHEN op = 'W' THEN op_id END AS op_id, CASE WHEN op = 'W' THEN value END AS value FROM j""",
    _as_of_probes,
)

# Runs cut by id and by key: both kinds, so that overlap and disjointness both occur.
_MANIFEST = f"""log AS (SELECT *, CASE WHEN op_id % 2 = 0 THEN CAST(op_id // 1000 AS BIGINT) ELSE 1000000 + CAST(key AS BIGINT) // 40 END AS run_id FROM ({LOGS['events']})),
    runs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY op_id DESC) AS rn FROM log) WHERE rn = 1),
    manifest AS (SELECT run_id AS file_id, CASE WHEN run_id < 1000000 THEN 0 ELSE 1 END AS level, min(key) AS first_key, max(key) AS last_key, count(*) AS rows, min(op_id) AS min_op_id, max(op_id) AS max_op_id FROM runs GROUP BY run_id)"""


def manifest_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _texts(log_of(spark, sf_dir))
    run = F.when(F.col("op_id") % 2 == 0, F.floor(F.col("op_id") / RUN)).otherwise(F.lit(1_000_000) + F.floor(F.col("key").cast("long") / 40))
    stats = storage.run_stats(storage.flush_runs(log, run))
    return stats.select(F.col("run_id").alias("file_id"), F.when(F.col("run_id") < 1_000_000, 0).otherwise(1).alias("level"), "first_key", "last_key", "rows", "min_op_id", "max_op_id")


def _level(spark, sf_dir, k: int) -> DataFrame:
    return manifest_of(spark, sf_dir).filter(F.col("level") == k)


_FILE = "file_id, level, first_key, last_key, rows, min_op_id, max_op_id"
query("run_stats", f"WITH {_MANIFEST} SELECT {_FILE} FROM manifest", manifest_of)
query("key_range", f"WITH {_MANIFEST} SELECT min(first_key) AS first_key, max(last_key) AS last_key FROM manifest", lambda s, d: storage.key_range(manifest_of(s, d)))
query("run_overlap_pairs", f"WITH {_MANIFEST} SELECT a.file_id AS left_id, b.file_id AS right_id FROM manifest a JOIN manifest b ON a.level = 0 AND b.level = 1 AND a.first_key <= b.last_key AND a.last_key >= b.first_key", lambda s, d: storage.overlap_pairs(_level(s, d, 0), _level(s, d, 1)))


SHIFT = 60  # targets' keys lie so much higher, so that some files of either side meet none of the other


def _split(k: int):
    """Inputs: the orders log in runs of 20 keys. Targets: the same with shifted keys, in runs of 30."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = _texts(log_of(spark, sf_dir, "orders"))
        number = F.col("key").cast("long")
        shifted = log.withColumn("key", X.padded(number + SHIFT))

        def files(rows: DataFrame, run_id, level: int) -> DataFrame:
            stats = storage.run_stats(storage.flush_runs(rows, run_id))
            return stats.select(F.col("run_id").alias("file_id"), F.lit(level).alias("level"), "first_key", "last_key", "rows", "min_op_id", "max_op_id")

        return storage.split_inputs(files(log, F.floor(number / 20), 0), files(shifted, F.lit(1_000_000) + F.floor(number / 30), 1))[k]

    return run


_STATS = "min(key) AS first_key, max(key) AS last_key, count(*) AS rows, min(op_id) AS min_op_id, max(op_id) AS max_op_id"
_SPLIT = f"""newest AS (SELECT CAST(key AS BIGINT) AS k, max(op_id) AS op_id FROM ({LOGS['orders']}) GROUP BY key),
    i AS (SELECT file_id, 0 AS level, {_STATS} FROM (SELECT k // 20 AS file_id, lpad(CAST(k AS VARCHAR), 6, '0') AS key, op_id FROM newest) GROUP BY file_id),
    t AS (SELECT file_id, 1 AS level, {_STATS} FROM (SELECT 1000000 + (k + {SHIFT}) // 30 AS file_id, lpad(CAST(k + {SHIFT} AS VARCHAR), 6, '0') AS key, op_id FROM newest) GROUP BY file_id)"""
_HIT = "EXISTS (SELECT 1 FROM {0} y WHERE x.first_key <= y.last_key AND x.last_key >= y.first_key{1})"
_MERGE = f"({_HIT.format('t', '')} OR {_HIT.format('i', ' AND x.file_id <> y.file_id')})"
query("runs_to_compact", f"WITH {_SPLIT} SELECT {_FILE} FROM i x WHERE {_MERGE}", lambda s, d: _split(0)(s, d))
query("runs_pass_through", f"WITH {_SPLIT} SELECT {_FILE} FROM i x WHERE NOT {_MERGE}", lambda s, d: _split(1)(s, d))
query("targets_to_compact", f"WITH {_SPLIT} SELECT {_FILE} FROM t x WHERE {_HIT.format('i', '')}", lambda s, d: _split(2)(s, d))
query("targets_that_stay", f"WITH {_SPLIT} SELECT {_FILE} FROM t x WHERE NOT {_HIT.format('i', '')}", lambda s, d: _split(3)(s, d))
query("level_table_counts", f"WITH {_MANIFEST}, l AS (SELECT CAST(range AS INTEGER) AS level FROM range(4)) SELECT l.level, count(file_id) AS n_files FROM l LEFT JOIN manifest m ON l.level = m.level GROUP BY l.level", lambda s, d: storage.level_counts(manifest_of(s, d), 4))
query(
    "need_compact",
    f"WITH {_MANIFEST}, l AS (SELECT CAST(range AS INTEGER) AS level FROM range(4)), c AS (SELECT l.level, count(file_id) AS n_files FROM l LEFT JOIN manifest m ON l.level = m.level GROUP BY l.level) SELECT level, n_files, CAST(2 * pow(2, level) AS BIGINT) AS capacity, n_files > CAST(2 * pow(2, level) AS BIGINT) AS over FROM c",
    lambda s, d: storage.need_compact(storage.level_counts(manifest_of(s, d), 4), LIMIT, RATIO),
)
query("level_capacity", "SELECT CAST(range AS INTEGER) AS level, CAST(4 * pow(3, range) AS BIGINT) AS capacity FROM range(8)", lambda s, d: s.range(8).select(F.col("id").cast("int").alias("level"), X.level_capacity("id", 4, 3).alias("capacity")))
query(
    "compaction_pick",
    f"WITH {_MANIFEST}, c AS (SELECT level, count(*) AS n, min(file_id) AS oldest FROM manifest GROUP BY level) SELECT m.file_id, m.level, first_key, last_key, rows, min_op_id, max_op_id FROM manifest m JOIN c ON m.level = c.level WHERE n > 2 * pow(2, m.level) AND (m.level = 0 OR m.file_id = oldest)",
    lambda s, d: storage.pick(manifest_of(s, d), LIMIT, RATIO),
)
query("assemble_level_index", f"WITH {_MANIFEST} SELECT {_FILE}, CAST(row_number() OVER (PARTITION BY level ORDER BY first_key, file_id) - 1 AS INTEGER) AS idx FROM manifest", lambda s, d: storage.assemble_level(_level(s, d, 0), _level(s, d, 1)))
query("overlap_bounds", f"WITH {_MANIFEST}, x AS (SELECT *, CAST(row_number() OVER (ORDER BY first_key, file_id) - 1 AS INTEGER) AS idx FROM manifest WHERE level = 1) SELECT min(idx) AS lo, max(idx) AS hi FROM x WHERE first_key <= '000050' AND last_key >= '000030'", lambda s, d: storage.overlap_bounds("000030", "000050", storage.assemble_level(_level(s, d, 1))))
query("compaction_preview", f"WITH {_MANIFEST} SELECT {_FILE} FROM manifest m WHERE level = 0 OR file_id = (SELECT min(file_id) FROM manifest n WHERE n.level = m.level)", lambda s, d: storage.pick_preview(manifest_of(s, d)))
query("tables_by_level", f"WITH {_MANIFEST} SELECT level, file_id FROM manifest", lambda s, d: storage.tables_by_level(manifest_of(s, d)))
query("storage_totals", f"WITH {_MANIFEST} SELECT count(*) AS n_files, max(level) + 1 AS depth, CAST(sum(rows) AS BIGINT) AS n_rows FROM manifest", lambda s, d: storage.totals(manifest_of(s, d)))
query("prune_files", f"WITH {_MANIFEST} SELECT {_FILE} FROM manifest WHERE first_key <= '000050' AND last_key >= '000045'", lambda s, d: storage.prune(manifest_of(s, d), "000045", "000050"))
query("op_sequence", f"SELECT key, op_id AS old_id, row_number() OVER (ORDER BY key, op_id) - 1 + 500 AS op_id FROM ({LOGS['events']})", lambda s, d: oplog.sequence(log_of(s, d).select("key", F.col("op_id").alias("old_id")), 500, ["key", "old_id"]))
query(
    "memtable_fill",
    f"WITH log AS (SELECT op_id, 17 + strlen(key) + CASE WHEN op = 'W' THEN 8 + strlen('v' || CAST(op_id AS VARCHAR)) ELSE 0 END AS size FROM ({LOGS['events']})) SELECT op_id, CAST(sum(size) OVER (ORDER BY op_id) AS BIGINT) AS filled_bytes FROM log",
    lambda s, d: storage.memtable_bytes(_texts(log_of(s, d))),
)
query(
    "scalar_functions",
    "SELECT event_id, strlen(props) AS n_bytes, lpad(CAST(event_id AS VARCHAR), 8, '0') AS padded FROM events",
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", X.byte_length("props").alias("n_bytes"), X.padded("event_id", 8).alias("padded")),
)
query("duplicate_op_ids", f"SELECT op_id, count(*) AS n FROM ({LOGS['orders']}) GROUP BY op_id HAVING count(*) > 1", lambda s, d: oplog.duplicate_ids(log_of(s, d, "orders")))


def _manifest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file is added at its first id; then one commit deletes what compaction picks and moves deeper files down."""
    files = manifest_of(spark, sf_dir)
    picked = storage.pick(files, LIMIT, RATIO)
    added = files.select(F.col("min_op_id").alias("version"), F.lit("Add").alias("change"), "file_id", "level")
    deleted = picked.select(F.lit(LATER).alias("version"), F.lit("Delete").alias("change"), "file_id", "level")
    moved = picked.filter("level > 0").select(F.lit(LATER).alias("version"), F.lit("Add").alias("change"), "file_id", (F.col("level") + 1).alias("level"))
    return added.unionByName(deleted).unionByName(moved)


LATER = 1 << 40
query(
    "manifest_replay",
    f"""WITH {_MANIFEST}, c AS (SELECT level, count(*) AS n, min(file_id) AS oldest FROM manifest GROUP BY level),
    picked AS (SELECT m.file_id, m.level FROM manifest m JOIN c ON m.level = c.level WHERE n > 2 * pow(2, m.level) AND (m.level = 0 OR m.file_id = oldest))
    SELECT file_id, level FROM manifest WHERE file_id NOT IN (SELECT file_id FROM picked) UNION ALL SELECT file_id, level + 1 FROM picked WHERE level > 0""",
    lambda s, d: storage.replay(_manifest_changes(s, d)),
)

query(
    "target_delete_changes",
    f"WITH {_SPLIT}, x AS (SELECT *, CAST(row_number() OVER (ORDER BY first_key, file_id) - 1 AS INTEGER) AS idx FROM t) SELECT idx, file_id, 'Delete' AS change FROM x WHERE {_HIT.format('i', '')}",
    lambda s, d: storage.delete_changes(storage.assemble_level(_split(2)(s, d).unionByName(_split(3)(s, d))).join(_split(2)(s, d).select("file_id"), "file_id", "left_semi")),
)
query(
    "target_add_changes",
    f"WITH {_SPLIT}, u AS (SELECT * FROM t x WHERE NOT {_HIT.format('i', '')} UNION ALL SELECT * REPLACE (1 AS level) FROM i x WHERE NOT {_MERGE}), r AS (SELECT *, CAST(row_number() OVER (ORDER BY first_key, file_id) - 1 AS INTEGER) AS idx FROM u) SELECT idx, file_id, 'Add' AS change FROM r WHERE file_id < 1000000",
    lambda s, d: _moved_in(s, d),
)


def _moved_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs that pass through join the targets that stay, at their places by first key."""
    passing = _split(1)(spark, sf_dir).withColumn("level", F.lit(1))
    return storage.add_changes(storage.assemble_level(_split(3)(spark, sf_dir), passing), passing)


query(
    "memtables",
    f"WITH log AS (SELECT op_id, 17 + strlen(key) + CASE WHEN op = 'W' THEN 8 + strlen('v' || CAST(op_id AS VARCHAR)) ELSE 0 END AS size FROM ({LOGS['events']})), f AS (SELECT size, sum(size) OVER (ORDER BY op_id) AS filled FROM log) SELECT CAST((filled - size) // 4096 AS BIGINT) AS memtable, count(*) AS n_ops, CAST(sum(size) AS BIGINT) AS bytes, max(filled) >= ((filled - size) // 4096 + 1) * 4096 AS sealed FROM f GROUP BY (filled - size) // 4096".replace("max(filled) >= ((filled - size) // 4096 + 1) * 4096 AS sealed", "max(filled) >= (max((filled - size) // 4096) + 1) * 4096 AS sealed"),
    lambda s, d: storage.memtables(_texts(log_of(s, d)), 4096),
)
query("lossy_text", "SELECT event_id, props AS text, CAST(strlen(props) AS INTEGER) AS n_bytes FROM events", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", X.lossy_text(F.col("props").cast("binary")).alias("text"), X.byte_length("props").alias("n_bytes")))
