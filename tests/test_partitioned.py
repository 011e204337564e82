"""Stream queries on tables that are folders of part files, as large tables are."""

import compare
import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
STREAMS = ["sm1_liveness_periods", "sm1_liveness_ticks", "sm2_log_tail", "sm3_settings_stream", "sm4_continuous_mirror", "sm6_lease_periods"]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("parts"))
    con = duckdb.connect()
    for name in compare.TABLES:
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").repartition(3).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return folder, con


@pytest.mark.parametrize("name", STREAMS)
def test_streams_read_every_part(spark, parts, name):
    folder, con = parts
    assert compare.difference(spark, folder, entry.queries()[name], entry.oracle_sql()[name], con) is None


def test_listing_has_a_task_per_root(spark, tmp_path):
    from pyspark.sql import functions as F

    from quayside.sources.listings import list_objects

    roots = []
    for i in range(6):
        (tmp_path / f"r{i}").mkdir()
        (tmp_path / f"r{i}" / "x").write_text("y")
        roots.append((f"file://{tmp_path}/r{i}",))
    listed = list_objects(spark.createDataFrame(roots, "root string"))
    tasks = listed.select("root", F.spark_partition_id().alias("task")).collect()
    assert len(tasks) == 6 and len({r["task"] for r in tasks}) >= 5


def test_late_heartbeats_are_not_lost(spark):
    from quayside.streaming.liveness import liveness_periods, to_the_end

    rows = spark.sql("SELECT 'a' AS node_id, TIMESTAMP '2024-01-01 00:00:00' AS ts, array('gc') AS services UNION ALL SELECT 'b', TIMESTAMP '2024-01-02 00:00:00', array('gc')")
    emitted = liveness_periods(rows.filter("false"), 30)
    got = to_the_end(emitted, rows, "node_id", "down_at", lambda r: liveness_periods(r, 30))
    assert {r["node_id"]: r["down_at"] is None for r in got.collect()} == {"a": False, "b": True}


def test_shuffles_are_cut_by_the_rows_that_are_read(spark, tmp_path):
    from quayside.catalog.fixtures import Fixtures

    spark.range(1_000_000).withColumnRenamed("id", "l_orderkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(10).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    fx = Fixtures(spark, str(tmp_path))
    lines, orders = fx.table("lineitem"), fx.table("orders")
    for table in (lines, orders):
        plan = table.distinct()._jdf.queryExecution().executedPlan().toString()
        assert ", 5)" in plan, plan


def test_newest_manifests_are_hashed_and_not_sorted(spark):
    from quayside.operators.snapshot import heads

    rows = [(1, 7, "a"), (1, 9, "b"), (1, 9, "c"), (2, None, "d"), (None, 3, "e"), (3, None, None), (3, 1, None)]
    given = spark.createDataFrame(rows, "db_key bigint, manifest_id bigint, note string")
    got = {r["db_key"]: (r["manifest_id"], r["note"]) for r in heads(given).collect()}
    assert got == {1: (9, "c"), 2: (None, "d"), None: (3, "e"), 3: (1, None)}
    stored = spark.createDataFrame(rows * 3, given.schema)
    first = heads(stored)._jdf.queryExecution().executedPlan().toString()
    assert "functions=[partial_max(manifest_id" in first and "HashAggregate" in first
