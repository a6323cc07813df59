"""The store, streams and codecs: golden vectors, a dictionary model, and regressions."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tidelog.config import Config, ConfigInvalid, ConfigNotFound, LevelConfig, StorageConfig, TableConfig
from tidelog.functions import scalars as X
from tidelog.operators import oplog, storage, versions
from tidelog.sources import wire
from tidelog.store import Conflict, Store, read_runs
from tidelog.streaming.ingest import Writer, ingest, latest_view, request_bytes

SMALL = Config(lsm_storage_config=StorageConfig(1024, LevelConfig(2, 2, TableConfig(256))), request_queue_size=200)


def log(spark, rows):
    return spark.createDataFrame([(i, bytearray(str(k).encode()), "D" if v is None else "W", None if v is None else bytearray(str(v).encode())) for i, k, v in rows], oplog.SCHEMA)


def found(df):
    return {bytes(r.key).decode(): bytes(r.value).decode() for r in df.collect()}


def test_versions_and_tombstones(spark):
    d = log(spark, [(0, "k", "v1"), (1, "k", "v2"), (2, "k", None), (3, "k", "v3"), (4, "e", "")])
    want = {0: "v1", 1: "v2", 2: None, 3: "v3", 9: "v3"}
    for at, v in want.items():
        assert found(versions.snapshot(d, at)).get("k") == v
    assert found(versions.snapshot(d))["e"] == ""  # an empty value is no delete
    mixed = log(spark, [(6, "d", None), (0, "b", 0), (2, "c", 2), (1, "a", 1), (3, "b", 3), (5, "a", 5), (4, "a", 4), (7, "d", 7)])
    assert found(versions.snapshot(mixed)) == {"a": "5", "b": "3", "c": "2", "d": "7"}
    assert [(r.op_id) for r in versions.latest(mixed, 6).orderBy("key").collect()] == [5, 3, 2, 6]


def test_merge_of_runs(spark):
    runs = [[(1, 1), (3, 3), (4, 4), (7, 7), (10, 99)], [(2, 2), (5, 3), (6, 6), (28, 8), (9, 9)], [(11, 3), (18, 8)]]
    got = versions.merge_runs([log(spark, [(i, k, i) for i, k in r]) for r in runs]).collect()
    assert {(r.op_id, int(bytes(r.key))) for r in got} == {(1, 1), (2, 2), (11, 3), (4, 4), (6, 6), (7, 7), (28, 8), (9, 9), (10, 99)}


def test_sizes_and_scalars(spark):
    d = log(spark, [(1, "123", None), (2, "123", "234")])
    assert [r.s for r in d.orderBy("op_id").select(X.encode_size().alias("s")).collect()] == [20, 31]
    assert request_bytes([(b"key1", b"value1"), (b"key2", None)]) == 40
    assert spark.range(1).select(X.payload_crc(F.lit("123456789"))).first()[0] == 3421780262
    for limit, ratio, want in ((4, 2, [4, 8, 16]), (4, 3, [4, 12, 36]), (2, 10, [2, 20, 200])):
        assert [r[0] for r in spark.range(3).orderBy("id").select(X.level_capacity("id", limit, ratio)).collect()] == want
    with pytest.raises(Exception, match="too wide"):
        spark.range(1).select(X.padded(F.lit(1_000_000))).collect()
    assert spark.range(1).select(X.lossy_text(F.lit(bytearray(b"a\xff")))).first()[0].startswith("a")


@pytest.mark.parametrize(
    "probe, ranges, hits",
    [((0, 5), [(10, 20), (30, 40)], []), ((10, 20), [(10, 20), (30, 40)], [0]), ((15, 35), [(10, 20), (25, 35), (40, 50)], [0, 1]), ((0, 50), [(10, 20), (30, 40)], [0, 1]), ((20, 30), [(10, 20), (30, 40)], [0, 1]), ((0, 0), [(0, 0), (10, 20)], [0]), ((0, 10), [], [])],
)
def test_overlap(spark, probe, ranges, hits):
    z = lambda n: f"{n:06d}"
    files = spark.createDataFrame([(k, k, z(a), z(b)) for k, (a, b) in enumerate(ranges)], "file_id long, idx int, first_key string, last_key string")
    one = spark.createDataFrame([(9, 0, z(probe[0]), z(probe[1]))], files.schema)
    assert sorted(r.right_id for r in storage.overlap_pairs(one, files).collect()) == hits
    b = storage.overlap_bounds(z(probe[0]), z(probe[1]), files).first()
    assert (b.lo, b.hi) == ((hits[0], hits[-1]) if hits else (None, None))


def test_sweep_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(storage, "STRETCH", 8)
    r = random.Random(5)
    for n, m in ((40, 30), (1, 5), (0, 4), (4, 0)):
        sides = []
        for count in (n, m):
            ends = [sorted((r.randint(0, 60), r.randint(0, 60))) for _ in range(count)]
            sides.append([(k + 100 * len(sides), f"{a:03d}", f"{b:03d}") for k, (a, b) in enumerate(ends)])
        left, right = (spark.createDataFrame(x, "file_id long, first_key string, last_key string") for x in sides)
        meets = lambda x, y: x[1] <= y[2] and x[2] >= y[1]
        got = sorted((x.left_id, x.right_id) for x in storage.overlap_pairs(left, right).collect())
        assert got == sorted((x[0], y[0]) for x in sides[0] for y in sides[1] if meets(x, y))
        alone = [x[0] for x in sides[0] if not any(meets(x, y) for y in sides[1]) and sum(meets(x, y) for y in sides[0]) == 1]
        hit = [y[0] for y in sides[1] if any(meets(x, y) for x in sides[0])]
        merging, passing, taken, stay = ([x.file_id for x in df.orderBy("file_id").collect()] for df in storage.split_inputs(left, right))
        assert passing == alone and merging == [x[0] for x in sides[0] if x[0] not in alone]
        assert taken == hit and stay == [y[0] for y in sides[1] if y[0] not in hit]
    spark.catalog.clearCache()


def test_ids_are_dense_in_the_order_given(spark):
    rows = spark.range(10_000).selectExpr("id % 7 AS a", "id AS b", "'x' AS `a.b`")
    got = oplog.sequence(rows, 5, ["a", "b"]).orderBy("op_id").collect()
    assert [x.op_id for x in got] == list(range(5, 10_005)) and [(x.a, x.b) for x in got] == sorted((i % 7, i) for i in range(10_000))
    assert oplog.sequence(rows.limit(0), 5, ["a"]).collect() == []


def test_key_range_of_nothing_raises(spark):
    files = spark.createDataFrame([], "file_id long, first_key string, last_key string")
    with pytest.raises(Exception, match="no files"):
        storage.key_range(files).collect()


def test_as_of_join_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(versions, "STRETCH", 4)
    r = random.Random(1)
    rows = [(i, r.choice("abc"), None if r.random() < 0.3 else i) for i in range(60)]
    probes = [(p, r.choice("abcd"), r.randint(0, 70)) for p in range(80)]
    probes += [(80, None, 5), (81, "a", None), (82, None, None), (83, "a", -1)]
    p = spark.createDataFrame([(a, None if k is None else bytearray(k.encode()), t) for a, k, t in probes], "probe_id int, key binary, as_of long")
    want = {}
    for a, k, t in probes:
        seen = [(i, v) for i, kk, v in rows if kk == k and t is not None and i <= t]
        want[a] = seen[-1] if seen and seen[-1][1] is not None else (None, None)
    got = {x.probe_id: (x.op_id, None if x.value is None else int(bytes(x.value))) for x in versions.as_of_join(p, log(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("most", [0, 4, 1 << 20])
def test_as_of_join_divides_only_hot_groups_of_keys(spark, monkeypatch, most):
    """All keys divided, one of them, or none: the same answers, and rows carried over between stretches only for those."""
    monkeypatch.setattr(versions, "STRETCH", max(1, most))
    rows = [(i, "hot" if i % 4 else f"k{i:02d}", None if i % 7 == 0 else i) for i in range(40)]
    probes = [(p, "hot" if p % 2 else f"k{p:02d}", t) for p in range(40) for t in (3, 20, 60)]
    p = spark.createDataFrame([(n, bytearray(k.encode()), t) for n, (_, k, t) in enumerate(probes)], "probe_id int, key binary, as_of long")
    joined = versions.as_of_join(p, log(spark, rows))
    got = {x.probe_id: x.op_id for x in joined.collect()}
    seen = [[(i, v) for i, kk, v in rows if kk == k and i <= t][-1:] for _, k, t in probes]
    assert got == {n: s[0][0] if s and s[0][1] is not None else None for n, s in enumerate(seen)}
    carried = spark.createDataFrame([(k.encode(),) for k in {k for _, k, _ in probes} | {k for _, k, _ in rows}], "key binary").select(F.xxhash64("key").bitwiseAND(versions.GROUPS - 1).alias("g"))
    assert carried.distinct().count() == carried.count()  # no two keys of this test share a group
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("Window") == 2


def test_probes_that_see_nothing_are_dealt_apart_from_what_others_see(spark, monkeypatch):
    monkeypatch.setattr(versions, "STRETCH", 4)
    monkeypatch.setattr(versions, "BLIND", 3)
    probes = [(n, None if n % 2 else b"a", None if n % 3 == 0 else 9) for n in range(60)] + [(60, b"a", 9)]
    p = spark.createDataFrame([(n, None if k is None else bytearray(k), t) for n, k, t in probes], "probe_id int, key binary, as_of long")
    got = {x.probe_id: (x.as_of, x.op_id) for x in versions.as_of_join(p, log(spark, [(1, "a", 5), (7, "b", 6)])).collect()}
    assert got == {n: (t, 1 if k is not None and t is not None else None) for n, k, t in probes}


def batch(spark, pairs):
    return spark.createDataFrame([(n, bytearray(k.encode()), "D" if v is None else "W", None if v is None else bytearray(v.encode())) for n, (k, v) in enumerate(pairs)], "n long, key binary, op string, value binary")


def test_store_against_a_dictionary(spark, tmp_path):
    r = random.Random(7)
    store = Store(spark, str(tmp_path / "s"), SMALL)
    model, snapshots = {}, {}
    last = -1
    for step in range(9):
        pairs = [(f"{r.randint(0, 40):06d}", None if r.random() < 0.25 else str(r.random())) for _ in range(60)]
        got = store.write_batch(batch(spark, pairs), ["n"])
        assert got == last + len(pairs)
        last = got
        for k, v in pairs:
            model[k] = v
        snapshots[last] = {k: v for k, v in model.items() if v is not None}
        if step % 2:
            store.compact()
            assert not store.need_compact()
    again = Store(spark, str(tmp_path / "s"))
    assert again.config == SMALL and again.current_op_id() == last + 1
    for at, want in snapshots.items():  # history survives compaction and reopening
        assert found(again.reader(at).snapshot()) == want
    some = next(iter(snapshots[last]))
    assert again.reader().get(some.encode()).decode() == snapshots[last][some] and again.reader().get(b"none") is None
    got = found(again.reader().range_scan(b"000010", b"000020"))
    assert got == {k: v for k, v in snapshots[last].items() if "000010" <= k < "000020"}
    old = again.reader()
    again.write_batch(batch(spark, [(f"{i:06d}", "new") for i in range(41)]), ["n"])
    again.compact(collapse=True)
    assert found(old.snapshot()) == snapshots[last]
    assert set(found(again.reader().snapshot()).values()) == {"new"}
    assert again.vacuum() > 0 and set(found(again.reader().snapshot()).values()) == {"new"}
    assert again.describe().count() == len(again.state().files)


def test_compaction_moves_disjoint_files_and_loses_no_key(spark, tmp_path):
    store = Store(spark, str(tmp_path / "m"), SMALL)
    for lo in (0, 100, 200):  # three disjoint files over a limit of two: moves only
        store.write_batch(batch(spark, [(f"{i:06d}", str(i)) for i in range(lo, lo + 10)]), ["n"])
    before = {f.path for f in store.state().files}
    assert store.compact() == 1 and {f.path for f in store.state().files} == before
    assert [len(x) for x in store.state().levels] == [0, 3]
    # an output that spans the range of a file that stays must not hide keys
    for lo, hi in ((5, 9), (95, 106), (203, 205)):
        store.write_batch(batch(spark, [(f"{i:06d}", f"n{i}") for i in range(lo, hi)]), ["n"])
    store.compact()
    got = found(store.reader().snapshot())
    for i in [*range(0, 10), *range(95, 110), *range(200, 210)]:
        new = 5 <= i < 9 or 95 <= i < 106 or 203 <= i < 205
        assert got[f"{i:06d}"] == (f"n{i}" if new else str(i)) and store.reader().get(f"{i:06d}".encode()) is not None


def test_many_files_go_down_in_one_compaction(spark, tmp_path):
    """What is too much for the next levels goes to the one that holds it at once, with all it passes, and no key or version is lost."""
    store = Store(spark, str(tmp_path / "d"), Config(lsm_storage_config=StorageConfig(1024, LevelConfig(2, 2, TableConfig(1)))))
    model, snapshots = {}, {}
    for step in range(3):
        for lo in (0, 300, 600):
            pairs = [(f"{i:06d}", None if (i + step) % 5 == 0 else f"{step}-{i}") for i in range(lo, lo + 400)]
            model.update(pairs)
            snapshots[store.write_batch(batch(spark, pairs), ["n"])] = {k: v for k, v in model.items() if v is not None}
        assert store.compact() == 1 and not store.need_compact()
        assert sum(f.rows for f in store.state().files) == 1200 * (step + 1)
    assert len(store.state().levels) > 4 and not any(store.state().levels[:3])
    for at, want in snapshots.items():
        assert found(store.reader(at).snapshot()) == want
    store.compact(collapse=True)
    want = {k: v for k, v in model.items() if v is not None}
    assert found(store.reader().snapshot()) == want and store.reader().get(b"000001").decode() == want["000001"]
    # levels that all hold the same take it in turns, and what is over goes down at once
    flat = Store(spark, str(tmp_path / "flat"), Config(lsm_storage_config=StorageConfig(1024, LevelConfig(4, 1, TableConfig(1)))))
    for k in range(5):
        flat.write_batch(batch(spark, [(f"{i:06d}", f"{k}") for i in range(200)]), ["n"])
    assert 0 < flat.compact() < 5 and not flat.need_compact() and set(found(flat.reader().snapshot()).values()) == {"4"}


@pytest.mark.parametrize("retain_from, left", [(None, 40), (19, 70)])
def test_history_goes_from_files_that_meet_no_other(spark, tmp_path, retain_from, left):
    """Each batch has keys of its own, twice; what is left is cut into files by its own size."""
    store = Store(spark, str(tmp_path / "h"), Config(lsm_storage_config=StorageConfig(1024, LevelConfig(2, 2, TableConfig(1)))))
    for lo in range(0, 40, 10):
        store.append_ops(log(spark, [(2 * i + n, f"{i:06d}", str(n)) for i in range(lo, lo + 10) for n in (0, 1)]))
    assert store.compact(retain_from, collapse=retain_from is None) == 1
    files = store.state().files
    assert sum(f.rows for f in files) == left and len(files) == 1 + (retain_from or 0) // 19 * 3
    assert set(found(store.reader().snapshot()).values()) == {"1"} and len(found(store.reader(retain_from).snapshot())) == (10 if retain_from else 40)


def test_ids_from_outside_are_looked_at_before_the_commit(spark, tmp_path):
    store = Store(spark, str(tmp_path / "ids"), SMALL)
    assert store.append_ops(log(spark, [(0, "a", 1), (1, "b", 2)])) == 1
    for rows in ([(2, "a", 1), (2, "b", 2)], [(1, "c", 1), (5, "d", 2)]):
        with pytest.raises(ValueError, match="unique and new"):
            store.append_ops(log(spark, rows))
    assert found(store.reader().snapshot()) == {"a": "1", "b": "2"} and store.current_op_id() == 2
    assert len(store.files.names("runs")) == 1 and not store.files.names("pending")


def test_tombstones_leave_the_deepest_level(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), SMALL)
    for pairs in ([("0", "a"), ("1", "1"), ("2", None)], [("0", None), ("1", "1_new"), ("3", "x")], [("3", None), ("4", "4")]):
        store.write_batch(batch(spark, pairs), ["n"])
    store.compact(collapse=True)
    assert found(store.reader().snapshot()) == {"1": "1_new", "4": "4"}
    assert sum(f.rows for f in store.state().files) == 2


def test_lost_races_and_damaged_commits(spark, tmp_path):
    store = Store(spark, str(tmp_path / "c"), SMALL)
    stale = store.state()
    store.write_batch(batch(spark, [("a", "1")]), ["n"])
    with pytest.raises(Conflict):
        store._commit(stale)
    name = [n for n in store.files.names("log") if n[0].isdigit()][0]
    data = store.files.read(f"log/{name}")
    store.files.replace(f"log/{name}", data.replace(b"next_op_id", b"next_op_iD"))
    with pytest.raises(ValueError, match="checksum"):
        Store(spark, store.path).state()
    with pytest.raises(Exception, match="malformed"):
        Store(spark, str(tmp_path / "d"), SMALL).write_batch(spark.createDataFrame([(bytearray(b"k"), "X", None)], "key binary, op string, value binary"))


@pytest.mark.parametrize("left", [0, 1, 40, -1])
def test_a_cut_off_last_commit_counts_as_absent(spark, tmp_path, left):
    store = Store(spark, str(tmp_path / "torn"), SMALL)
    for k in "ab":
        store.write_batch(batch(spark, [(k, k)]), ["n"])
    name = f"log/{1:020d}.json"
    store.files.replace(name, store.files.read(name)[:left])
    again = Store(spark, store.path)
    assert again.state().version == 0 and found(again.reader().snapshot()) == {"a": "a"}
    assert again.write_batch(batch(spark, [("c", "c")]), ["n"]) == 1
    assert found(Store(spark, store.path).reader().snapshot()) == {"a": "a", "c": "c"}
    store.files.replace(f"log/{0:020d}.json", b"")
    with pytest.raises(ValueError, match="incomplete"):
        Store(spark, store.path).state()
    store.files.delete(f"log/{0:020d}.json")
    with pytest.raises(ValueError, match="missing"):
        Store(spark, store.path).state()


def test_vacuum_leaves_a_batch_that_is_being_written(spark, tmp_path, monkeypatch):
    """Vacuum runs between the write of the files and their commit, and after a writer that failed."""
    store = Store(spark, str(tmp_path / "v"), SMALL)
    store.write_batch(batch(spark, [("a", "1")]), ["n"])
    commit, gone = Store._commit, []

    def late(self, *a, **k):
        gone.append(Store(spark, store.path).vacuum())
        return commit(self, *a, **k)

    monkeypatch.setattr(Store, "_commit", late)
    store.write_batch(batch(spark, [("b", "2")]), ["n"])
    assert gone == [0] and found(store.reader().snapshot()) == {"a": "1", "b": "2"}

    def fails(self, *a, **k):
        raise OSError("lost")

    monkeypatch.setattr(Store, "_commit", fails)
    with pytest.raises(OSError):
        store.write_batch(batch(spark, [("c", "3")]), ["n"])
    monkeypatch.setattr(Store, "_commit", commit)
    assert store.vacuum() == 1 and found(store.reader().snapshot()) == {"a": "1", "b": "2"}
    # a writer that died leaves its mark: its folder stays until the mark is old
    store._write_runs(log(spark, [(9, "x", "y")]), 0, 99, None)
    assert store.vacuum() == 0 and store.vacuum(stale=0) == 1
    # files that are gone are never committed
    files = store._write_runs(log(spark, [(9, "x", "y")]), 0, 99, None)
    store.vacuum(stale=0)
    with pytest.raises(Conflict, match="gone"):
        store._commit(store.state(), files)


def test_checkpoints_of_the_manifest(spark, tmp_path):
    store = Store(spark, str(tmp_path / "k"), SMALL)
    for k in range(18):
        state = store._commit(store.state(), next_op_id=k + 1, batches={"s": k})
    assert [n for n in store.files.names("log") if n.startswith("checkpoint-")] == [f"checkpoint-{15:020d}.json"]
    again = Store(spark, store.path)
    assert again.state() == state and again.state(3).next_op_id == 4 and again.state(15).batches == {"s": 15}
    for k in range(15):
        store.files.delete(f"log/{k:020d}.json")
    assert Store(spark, store.path).state() == state


def test_memtables_are_sealed_flushed_and_gated(spark, tmp_path):
    """Layered reads over active and sealed memtables and level 0, and the gate of the flush."""
    store = Store(spark, str(tmp_path / "f"), Config(lsm_storage_config=StorageConfig(120, LevelConfig(1, 2, TableConfig(256)))))
    put = lambda *pairs: store.write_batch(batch(spark, pairs), ["n"], memtable=True)
    put(("30", "a"), ("40", "b"))
    state = store.state()
    assert state.levels == ((),) and not state.sealed and state.memtable_bytes() > 0 and not store.flush()
    put(("30", "c" * 90))  # over the limit: sealed with the batch that reaches it
    assert store.state().sealed == (0,) and store.state().memtable_bytes() == 0 and store.need_flush()
    put(("40", None), ("50", "e"))
    assert found(store.reader().snapshot()) == {"30": "c" * 90, "50": "e"}
    assert found(store.reader(1).snapshot()) == {"30": "a", "40": "b"}
    assert [(r.memtable, r.sealed) for r in store.memtables().orderBy("memtable").collect()] == [(0, True), (1, False)]
    assert sorted({(r.level, r.idx) for r in store.describe().collect()}) == [(-1, 0), (-1, 1)]
    for k in range(2):
        assert store.freeze()
        put((f"6{k}", "x"))
    assert store.freeze() and not store.freeze()
    assert len(store.state().sealed) == 4
    done = store.flush()  # level 0 may hold one over its limit, then the gate shuts
    assert 0 < done < 4 and len(store.state().levels[0]) > 1 and not store.need_flush()
    store.maintain()
    assert not store.state().sealed and not store.state().memory and not store.need_compact()
    again = Store(spark, store.path).reader()
    assert found(again.snapshot()) == {"30": "c" * 90, "50": "e", "60": "x", "61": "x"} and found(again.at(1).snapshot()) == {"30": "a", "40": "b"}


def test_a_memtable_of_one_batch_is_flushed_without_being_written_again(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "mv"), SMALL)
    store.append_ops(log(spark, [(k, f"{k:02d}", k) for k in range(20)]), memtable=True)
    store.freeze()
    before = store.state()
    monkeypatch.setattr(Store, "_write_runs", lambda *a, **k: pytest.fail("written again"))
    assert store.flush(gate=False) == 1
    monkeypatch.undo()
    after = store.state()
    assert not after.sealed and not after.memory and {f.path for f in after.levels[0]} == {f.path for f in before.memory}
    assert all(f.level == 0 and f.memtable is None for f in after.levels[0])
    for k in (20, 21):  # two batches in one memtable become one run
        store.append_ops(log(spark, [(k, "05", k)]), memtable=True)
    store.freeze()
    store.flush(gate=False)
    assert len({f.folder for f in store.state().levels[0]}) == 2
    again = Store(spark, store.path).reader()
    assert found(again.snapshot()) == {f"{k:02d}": str(21 if k == 5 else k) for k in range(20)} and found(again.at(19).snapshot())["05"] == "5"


def test_run_files_are_read_by_folder_and_by_size(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameReader

    store = Store(spark, str(tmp_path / "r"), SMALL)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        store.append_ops(log(spark, [(k, f"k{k:03d}", k) for k in range(400)]))
        store.append_ops(log(spark, [(400, "large", int("9" * 3000))]))
    finally:
        spark.conf.unset(coalesce)
    files = store.state().files
    first = [f for f in files if f.min_op_id < 400]
    assert len(first) > 2 and all(f.together == len(first) for f in first)
    named, parquet = [], DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *paths, **k: (named.append(paths), parquet(self, *paths, **k))[1])
    assert read_runs(spark, files).count() == 401 and sorted(map(len, named)) == [1, 1]  # two scans, a folder each
    named.clear()
    assert read_runs(spark, first[:-1]).count() == 400 - first[-1].rows and [len(p) for p in named] == [len(first) - 1]
    assert read_runs(spark, []).count() == 0


def test_ids_that_occur_twice_leave_nothing_behind(spark, tmp_path):
    store = Store(spark, str(tmp_path / "u"), SMALL)
    store.append_ops(log(spark, [(0, "a", 1)]))
    kept = store.files.names("runs")
    for rows in ([(1, "a", 1), (1, "b", 2)], [(0, "b", 2), (5, "c", 3)]):
        with pytest.raises(ValueError):
            store.append_ops(log(spark, rows))
        assert store.files.names("runs") == kept and not store.files.names("pending")
    assert store.append_ops(log(spark, [(1, "b", 2)])) == 1


def test_writer_acknowledges_and_drains(spark, tmp_path):
    store = Store(spark, str(tmp_path / "w"), SMALL)
    w = Writer(store)
    acks = [w.put([(b"a", b"1"), (b"b", b"2"), (b"a", b"3"), (b"c", None), (b"d", b"")]), w.put([]), w.put([(b"b", None)])]
    w.close()
    assert [f.result() for f in acks] == [4, 5, 5] and store.current_op_id() == 6
    assert found(store.reader().snapshot()) == {"a": "3", "d": ""}
    assert not store.state().memory and not store.state().sealed  # closing seals and flushes
    with pytest.raises(RuntimeError):
        w.put([])
    w.close()


def test_no_future_is_left_open_by_closing(spark, tmp_path):
    import threading

    store = Store(spark, str(tmp_path / "race"), SMALL)
    w = Writer(store)
    futures, refused = [], []

    def client():
        for _ in range(200):
            try:
                futures.append(w.put([]))
            except RuntimeError:
                refused.append(1)

    threads = [threading.Thread(target=client) for _ in range(4)]
    for t in threads:
        t.start()
    w.close()
    for t in threads:
        t.join()
    assert len(futures) + len(refused) == 800 and all(f.result(timeout=30) == 0 for f in futures)


def test_background_compaction_and_back_pressure(spark, tmp_path):
    """Every memtable is sealed by one batch; writers wait for the flush of sealed ones, and levels stay under capacity."""
    config = Config(lsm_storage_config=StorageConfig(60, LevelConfig(1, 2, TableConfig(256))), imm_num_limit=1, thread_sleep_time=50, request_queue_size=1)
    store = Store(spark, str(tmp_path / "bg"), config)
    w = Writer(store)
    most = 0
    for k in range(6):
        w.put([(f"{j}".encode(), f"{k}".encode()) for j in range(4)]).result(timeout=120)
        most = max(most, len(store.state().sealed))
    w.trigger_compact(wait=True)
    assert most <= config.imm_num_limit and store.compactions > 0 and not store.need_compact() and not store.state().sealed
    w.close()
    assert found(store.reader().snapshot()) == {str(j): "5" for j in range(4)}
    # without auto_compact nothing happens until it is asked for
    store = Store(spark, str(tmp_path / "manual"), Config(lsm_storage_config=StorageConfig(60, LevelConfig(1, 2, TableConfig(256))), auto_compact=False, thread_sleep_time=20, request_queue_size=1))
    w = Writer(store)
    w.put([(b"k", b"v" * 100)]).result(timeout=60)
    import time

    time.sleep(0.3)
    assert len(store.state().sealed) == 1
    w.trigger_compact(wait=True)
    assert not store.state().sealed and store.state().levels[0]
    w.close()


def test_stream_equals_batch_and_retries_write_once(spark, tmp_path):
    src = str(tmp_path / "src")
    r = random.Random(3)
    rows = [(i, f"k{r.randint(0, 9)}", None if r.random() < 0.2 else str(i)) for i in range(90)]
    for k in range(3):
        log(spark, rows[k * 30 : k * 30 + 30]).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(oplog.SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    store = Store(spark, str(tmp_path / "store"), SMALL)
    q = ingest(store, stream, str(tmp_path / "ck"), "src", ["op_id"])
    q.awaitTermination(120)
    assert store.current_op_id() == 90
    store.write_batch(log(spark, rows[60:]), ["op_id"], "src", 2)
    assert store.current_op_id() == 90
    assert len(found(store.reader().snapshot())) > 0
    view = latest_view(spark.readStream.schema(oplog.SCHEMA).parquet(src)).writeStream.format("memory").queryName("latest_view").outputMode("complete").trigger(availableNow=True).start()
    view.awaitTermination(120)
    got = spark.table("latest_view").select("op_id", "key", "op", "value")
    want = versions.latest(log(spark, rows))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_files_of_a_batch_meet_only_at_hot_keys_and_are_moved_down(spark, tmp_path, monkeypatch):
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    r = random.Random(8)
    rows = [(i, f"k{r.randint(0, 99):02d}", None if r.random() < 0.2 else i) for i in range(900)]
    try:
        store = Store(spark, str(tmp_path / "apart"), SMALL)
        store.append_ops(log(spark, rows[:600]))
        before = store.state().files
        assert len(before) > 2 and all(a.last_key < b.first_key for a, b in zip(before[::-1], before[-2::-1]))
        monkeypatch.setattr(Store, "_write_runs", lambda *a, **k: pytest.fail("written again"))
        assert store.compact() == 1
        monkeypatch.undo()
        after = store.state()
        assert not after.levels[0] and {f.path for f in after.files} == {f.path for f in before}
        store.append_ops(log(spark, rows[600:]))  # meets them all
        store.append_ops(log(spark, [(900 + i, "k50" if i % 4 else f"k{i:02d}", i) for i in range(99)]))
        held = [f for f in store.state().levels[0] if f.min_op_id >= 900 and f.meets(b"k50".hex().upper(), b"k50".hex().upper())]
        assert len(held) > 1
        store.compact()
    finally:
        spark.conf.unset(coalesce)
    assert not store.need_compact() and sum(f.rows for f in store.state().files) == 999
    for at in (300, 599, 750, 899):
        want = {k: str(v) for k, v in {k: v for i, k, v in rows if i <= at}.items() if v is not None}
        assert found(store.reader(at).snapshot()) == want


def test_a_batch_with_ids_of_its_own_is_written_in_their_order_by_many_tasks(spark, tmp_path, monkeypatch):
    sequence, dealt = oplog.sequence, []
    monkeypatch.setattr(oplog, "sequence", lambda *a: (out := sequence(*a), dealt.append(out._cached.select(F.spark_partition_id()).distinct().count()))[0])
    ids = random.Random(5).sample(range(0, 4000, 2), 2000)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        store = Store(spark, str(tmp_path / "ids"), SMALL)
        assert store.write_batch(log(spark, [(i, f"k{i % 7}", i) for i in ids]).repartition(5), ["op_id"], "src", 0) == 1999
    finally:
        spark.conf.unset(coalesce)
    got = store.reader().log().select("op_id", F.col("value").cast("string").cast("long").alias("old")).collect()
    assert len(got) == 2000 and all(r.old == 2 * r.op_id for r in got)
    assert dealt == [8]


def test_wire_formats(spark, tmp_path):
    assert wire.encode_record(1, b"123", "D", None).hex() == "01000000000000000300000000000000" + "313233" + "00"
    assert wire.encode_record(1, b"123", "W", b"234").hex() == "01000000000000000300000000000000" + "313233" + "01" + "0300000000000000" + "323334"
    ops = [(1, b"a", "W", b""), (2, b"b", "D", None), (3, b"c", "W", b"xyz")]
    data = wire.encode_wal(ops)
    assert list(wire.decode_wal(data)) == ops and list(wire.decode_wal(data[:-1])) == ops[:2] and list(wire.decode_wal(b"")) == []
    (tmp_path / "wal").mkdir()
    (tmp_path / "wal" / "1.wal").write_bytes(data)
    got = wire.read_wal(spark, str(tmp_path / "wal"))
    assert sorted((r.op_id, bytes(r.key), r.op, None if r.value is None else bytes(r.value)) for r in got.collect()) == ops
    assert [bytes(r.record) for r in wire.encoded(got).orderBy("op_id").collect()] == [wire.encode_record(*o) for o in ops]
    with pytest.raises(ValueError):
        wire.decode_record(struct.pack("<QQ", 1, 1) + b"k\x07")
    c = wire.Changes(1, (wire.Change(2, 42, "Delete"),), (wire.Change(5, 99, "Add"),))
    assert [wire.Changes.decode(p) for p in wire.frames(wire.frame(c.encode()) * 2)] == [c, c]
    for bad in (wire.frame(b"abc")[:-1], wire.frame(b"abc")[:5], wire.frame(b"abc")[:-4] + b"\x00" * 4):
        with pytest.raises(ValueError):
            list(wire.frames(bad))
    many = [wire.encode_record(i, b"k" * 20, "W", b"v" * 50) for i in range(200)]
    blocks = list(wire.pack_blocks(many))
    assert all(len(b) == 4096 for b in blocks) and [o[0] for b in blocks for o in wire.read_block(b)] == list(range(200))
    assert len(wire.encode_record(0, b"k", "W", b"v" * 4063)) == 4089
    assert [wire.first_key(b) for b in blocks] == [b"k" * 20] * len(blocks)
    block, n = wire.fill_block(many)
    assert block == blocks[0] and n == struct.unpack("<Q", block[-8:])[0]
    with pytest.raises(ValueError):
        wire.fill_block([])
    meta = wire.encode_block_meta(b"a", b"xyz")
    assert meta.hex() == "0100000000000000" + "61" + "0300000000000000" + "78797a"
    assert wire.decode_block_meta(b"--" + meta, 2) == ((b"a", b"xyz"), 2 + len(meta))
    with pytest.raises(ValueError):
        wire.decode_block_meta(meta[:-1])
    table = [(i, f"{i:06d}".encode(), "W", b"v" * 50) for i in range(300)]
    packed, metas, done = wire.fill_table(table, 2)
    assert len(packed) == len(metas) == 2 and done < 300 and [o for b in packed for o in wire.read_block(b)] == table[:done]
    assert [wire.decode_block_meta(m)[0] for m in metas][1][1] == table[done - 1][1]
    from tidelog.sources.files import Files

    files = Files(spark, str(tmp_path))
    names = [wire.append_wal(files, "batches", ops[:2]), wire.append_wal(files, "batches", ops[2:])]
    assert names == sorted(names) and wire.read_wal(spark, str(tmp_path / "batches")).count() == 3
    assert files.create("once", b"1") and not files.create("once", b"2") and files.read("once") == b"1"
    with pytest.raises(ValueError):
        list(wire.pack_blocks([b"x" * 4089]))


def test_config():
    assert Config.from_json(SMALL.to_json()) == SMALL
    with pytest.raises(ConfigNotFound):
        Config.from_json("")
    for bad in ("this is not valid json", "{}", '{"lsm_storage_config": 3}'):
        with pytest.raises(ConfigInvalid):
            Config.from_json(bad)


def test_a_hot_key_of_a_batch_is_written_by_many_tasks(spark, tmp_path):
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        store = Store(spark, str(tmp_path / "h"), SMALL)
        pairs = [("hot" if i % 3 else f"k{i:03d}", None if i == 1 else str(i)) for i in range(300)]
        assert store.write_batch(batch(spark, pairs), ["n"]) == 299
    finally:
        spark.conf.unset(coalesce)
    hot = b"hot".hex().upper()
    holding = [f for f in store.state().levels[0] if f.meets(hot, hot)]
    assert len(holding) > 1
    want = {"hot": "299", **{f"k{i:03d}": str(i) for i in range(0, 300, 3)}}
    assert found(store.reader().snapshot()) == want and found(store.reader(200).snapshot())["hot"] == "200"
    store.write_batch(batch(spark, [("hot", None)]), ["n"])
    store.compact(collapse=True)
    del want["hot"]
    assert found(store.reader().snapshot()) == want and not store.state().levels[0]


def test_logging(capsys):
    import logging

    from tidelog.config import enable_log

    logger = enable_log("INFO")
    assert enable_log(logging.WARNING) is logger and len(logger.handlers) == 1 and logger.level == logging.WARNING
