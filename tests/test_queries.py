"""Every registered query against the SQL that says the same, on DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from tidelog.config import Config, LevelConfig, StorageConfig, TableConfig
from tidelog.plans import queries, store_queries
from tidelog.store import Store

QUERIES, ORACLES = queries.QUERIES | store_queries.QUERIES, queries.ORACLES | store_queries.ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


def value(x):
    """Nulls are None and whole numbers integers, whatever pandas makes of a column that holds both."""
    if pd.isna(x):
        return None
    if isinstance(x, float):
        return int(x) if x.is_integer() else float(x)
    return x.item() if hasattr(x, "item") else x


def plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted((tuple(map(value, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.toPandas()) == plain(want)


@pytest.mark.parametrize("name", ["run_overlap_pairs", "runs_to_compact", "runs_pass_through", "targets_to_compact", "targets_that_stay", "op_sequence", "as_of_probe_join"])
def test_plans_hold_no_product(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "ExistingRDD" not in plan


@pytest.mark.parametrize("name", ["store_snapshot_orders", "store_collapse", "store_retention", "store_as_of_join", "store_get", "store_history", "store_memtable_snapshot", "store_range_scan", "store_multi_get", "store_reopen", "store_snapshot", "store_time_travel", "store_totals", "stream_ingest_totals"])
def test_stores_compact_once_a_batch(spark, monkeypatch, name):
    """With tables so small that a batch has many: none goes through the levels by itself."""
    count, levels = [], []
    compact = Store._compact_level

    def counted(self, *args):
        count.append(1)
        after = compact(self, *args)
        levels.append(len(after.levels))
        return after

    monkeypatch.setattr(Store, "_compact_level", counted)
    monkeypatch.setattr(store_queries, "SMALL", Config(lsm_storage_config=StorageConfig(1 << 12, LevelConfig(2, 2, TableConfig(1)))))
    QUERIES[name](spark, SF).collect()
    assert 0 < len(count) < store_queries.PARTS and max(levels) > 2


def test_stores_read_their_table_once(spark, monkeypatch):
    plans, append = [], Store.append_ops

    def noted(self, log, memtable=False):
        plans.append(log._jdf.queryExecution().withCachedData().toString())
        return append(self, log, memtable)

    monkeypatch.setattr(Store, "append_ops", noted)
    rows = QUERIES["store_history"](spark, SF).count()
    assert rows == spark.read.parquet(f"{SF}/events.parquet").count()
    assert len(plans) == store_queries.PARTS and all("InMemoryRelation" in p for p in plans)


def test_a_micro_batch_is_written_and_read_by_many_tasks(spark):
    store = store_queries._streamed(spark, SF)
    names = [n for n in os.listdir(f"{os.path.dirname(store.path)}/in") if n.endswith(".parquet")]
    assert len(names) == 24 and store.state().batches == {"files": 2}
    assert store.reader().log().count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_no_fixed_values_bound_what_is_read():
    assert not any("700" in sql for sql in ORACLES.values())
