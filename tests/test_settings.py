import math

import pytest
from pyspark.sql import functions as F

from quayside.operators import liveness, registry, settings, targets
from quayside.operators.reconcile import reconcile

DATABASES = [(1, "s3://data/user-data/a"), (2, "s3://data/user-database/b"), (3, "gs://x/y"), (4, "s3://data/user-data")]


@pytest.fixture(scope="module")
def databases(spark):
    return spark.createDataFrame(DATABASES, "db_key bigint, db_url string")


def test_each_field_falls_through_on_its_own(spark, databases):
    over = spark.createDataFrame(
        [(1, 3, None, None), (2, None, ["gc"], 7.5), (3, None, [], None)],
        "db_key bigint, compaction_workers_count bigint, services array<string>, gc_wal_interval_s double",
    )
    fleet = spark.createDataFrame([(2, 90.0)], "compaction_workers_count bigint, gc_wal_interval_s double")
    rows = {r.db_key: r for r in settings.resolve(databases, over, fleet).collect()}
    assert [(rows[k].compaction_workers_count, rows[k].gc_wal_interval_s) for k in (1, 2, 3, 4)] == [
        (3, 90.0), (2, 7.5), (2, 90.0), (2, 90.0)]
    assert [len(rows[k].services) for k in (1, 2, 3, 4)] == [4, 1, 0, 4]
    assert rows[4].gc_wal_fence_dry_run and not rows[4].gc_wal_dry_run
    assert rows[4].compaction_workers_compression_codec is None


def test_no_fleet_row_means_defaults(spark, databases):
    empty = spark.createDataFrame([], "compaction_workers_count bigint")
    assert {r.compaction_workers_count for r in settings.resolve(databases, None, empty).collect()} == {1}
    assert settings.resolve_node_settings(spark, None).first().node_heartbeat_timeout_s == 30.0


def test_url_and_prefix_travel_together(spark):
    fleet = spark.createDataFrame(
        [("a", "s3://dr", "s3://data", "periodic"), ("b", "s3://b", None, None)],
        "target string, url string, source_prefix string, mode string",
    )
    over = spark.createDataFrame(
        [(1, "a", "s3://own", None, None, None), (2, "a", None, None, True, None), (3, "new", "s3://n", None, None, 60.0),
         (4, "a", None, "s3://data/x", None, None)],
        "db_key bigint, target string, url string, source_prefix string, disabled boolean, retention_keep_s double",
    )
    inherited, tuned = settings.merge_targets(fleet, over)
    rows = {r.db_key: r for r in tuned.collect()}
    assert (rows[1].url, rows[1].source_prefix, rows[1].mode) == ("s3://own", None, "periodic")
    assert (rows[2].url, rows[2].source_prefix, rows[2].disabled) == ("s3://dr", "s3://data", True)
    assert (rows[3].mode, rows[3].retention_keep_s, rows[3].copy_parallelism) == ("continuous", 60.0, 8)
    assert (rows[4].url, rows[4].source_prefix) == (None, "s3://data/x")
    assert {r.target: r.mode for r in inherited.collect()} == {"a": "periodic", "b": "continuous"}


def applied(databases, spark, rows):
    df = spark.createDataFrame(rows, "target string, url string, source_prefix string, disabled boolean")
    inherited, _ = settings.merge_targets(df, spark.createDataFrame([], "db_key bigint, target string"))
    out = targets.applied_targets(databases, inherited).collect()
    return {(r.db_key, r.target): r.destination for r in out}


def test_prefixes_end_at_segments(spark, databases):
    got = applied(databases, spark, [("p", "S3://DR/m/", "s3://Data/user-data/", False)])
    assert got == {(1, "p"): "s3://dr/m/a", (4, "p"): "s3://dr/m"}


def test_exact_disabled_invalid_and_self_targets(spark, databases):
    got = applied(databases, spark, [
        ("exact", "gs://x/y", None, False), ("off", "s3://o", None, True), ("bad", "ftp://o", None, False),
        ("badprefix", "s3://o", "nope", False), ("nourl", None, "s3://data", False), ("self", "s3://data", "s3://data", False),
    ])
    assert got == {(k, "exact"): "gs://x/y" for k in (1, 2, 4)}


def test_collisions_name_every_source(spark):
    rows = spark.createDataFrame(
        [("u1", "t", "s3://d"), ("u2", "t", "s3://d"), ("u3", "t", "s3://e")], "db_url string, target string, destination string")
    found = targets.collisions(rows)
    assert sorted(r.message for r in targets.collision_messages(found).collect()) == [
        f"u{i} by target t shares the destination s3://d, one of 2" for i in (1, 2)]


def test_documents_are_closed_and_typed(spark):
    docs = [
        (1, '{"services":["gc"],"gc":{"wal":{"interval":"2m"}},"compactor-coordinator":{"scheduler":{"include_size_threshold":1.5}}}'),
        (2, '{"gc":{"wal":{"interval":"0s","oops":1}},"what":{}}'), (3, "{"), (4, ""), (5, None),
        (6, '{"services":["gc","gc","brew"],"compaction-workers":{"count":0,"compression_codec":"rar"}}'),
        (7, '{"gc":{"wal":{"interval":"soon"}},"mirror":{"targets":{}}}'),
    ]
    layer = settings.read_documents(spark.createDataFrame(docs, "db_key bigint, document string"), ["db_key"])
    rows = {r.db_key: r for r in layer.collect()}
    problems = {k: sorted((v.field, v.message) for v in r.violations) for k, r in rows.items()}
    assert problems[1] == problems[4] == problems[5] == []
    assert (rows[1].gc_wal_interval_s, rows[1].services) == (120.0, ["gc"])
    assert problems[2] == [("gc.wal.interval", "must be > 0"), ("gc.wal.oops", "is not a known setting"),
                           ("what", "is not a known setting")]
    assert problems[3] == [("", "is not a settings document")]
    assert problems[6] == [
        ("compaction-workers.compression_codec", "has an unknown value"), ("compaction-workers.count", "must be >= 1"),
        ("services", "has a repeated service"), ("services", "has an unknown service")]
    assert problems[7] == [("gc.wal.interval", "has the wrong type")]


def test_violation_reports(spark):
    layer = spark.createDataFrame(
        [(1, math.nan, 9), (2, math.inf, 3), (3, 1.0, 0)],
        "db_key bigint, compactor_coordinator_scheduler_include_size_threshold float, compactor_coordinator_scheduler_min_compaction_sources bigint")
    found = settings.layer_violations(layer, ["db_key"]).collect()
    assert sorted((r.db_key, r.field.split(".")[-1]) for r in found) == [
        (1, "include_size_threshold"), (2, "include_size_threshold"), (3, "min_compaction_sources")]
    resolved = settings.resolve(layer.select("db_key"), layer)
    assert [r.db_key for r in settings.resolved_violations(resolved, ["db_key"]).collect()] == [1]
    fleet = spark.createDataFrame([(30.0,)], "node_heartbeat_interval_s double")
    assert [r.message for r in settings.fleet_violations(fleet).collect()] == ["has to stay below node.heartbeat_timeout"]


def test_youngest_heartbeat_and_liveness(spark):
    rows = spark.createDataFrame(
        [("a", ["gc"], 5_000_000, "l1"), ("a", ["mirror"], 2_000_000, "l2"), ("b", ["gc"], 30_000_000, "l3"),
         ("c", ["gc"], 7, "l5"), ("c", [], 7, "l4")],
        "node_id string, services array<string>, age_micros bigint, location string").withColumn("last_modified", F.lit(None).cast("timestamp"))
    assert {r.node_id: r.location for r in liveness.youngest_per_node(rows).collect()} == {"a": "l2", "b": "l3", "c": "l4"}
    assert {r.node_id for r in liveness.live_nodes(rows, 30).collect()} == {"a", "c"}
    stale = liveness.stale_heartbeats(rows, spark.createDataFrame([("a", "l2")], "node_id string, location string"), 3)
    assert {(r.location, r.reason) for r in stale.collect()} == {("l1", "replaced"), ("l3", "long dead")}


def test_aliases_never_shadow_the_canonical_file(spark):
    listing = spark.createDataFrame(
        [("dbs/s3%3A%2F%2Fb%2Fdb.toml", 0), ("dbs/S3%3A%2F%2Fb%2Fdb.toml", 3), ("dbs/S3%3A%2F%2Fb%2Fonly%2F.toml", 0), ("dbs/README.md", 9)],
        "path string, size bigint")
    entries = registry.registry_entries(listing)
    groups = registry.alias_groups(entries)
    assert {r.url: r.file_name for r in groups.filter("wins").collect()} == {
        "s3://b/db": "s3%3A%2F%2Fb%2Fdb.toml", "s3://b/only": "S3%3A%2F%2Fb%2Fonly%2F.toml"}
    assert registry.registry_warnings(entries, groups).count() == 4


def test_reconcile_is_null_safe(spark):
    schema = "db_url string, service string, target string, fingerprint bigint"
    owned = spark.createDataFrame([("u", "gc", None, 1), ("u", "mirror", "a", 1), ("v", "gc", None, 2)], schema)
    running = spark.createDataFrame([("u", "gc", None, 1), ("u", "mirror", "b", 1), ("v", "gc", None, 9)], schema)
    got = {(r.db_url, r.service, r.target): r.action for r in reconcile(owned, running).collect()}
    assert got == {("u", "gc", None): "keep", ("u", "mirror", "a"): "start", ("u", "mirror", "b"): "stop", ("v", "gc", None): "restart"}


def test_documents_and_names_are_dealt_by_their_number(spark):
    """One small file holds many rows that are dear to read: they do not stay in the task that reads it."""
    rows = spark.range(25_000).coalesce(1)
    layer = settings.read_documents(rows.selectExpr("id AS db_key", "'{}' AS document"), ["db_key"])
    # A filter on what was read does not move it back into the one task.
    kept = layer.filter("size(violations) = 0").select("db_key", F.spark_partition_id().alias("task"))
    assert {r["count"] for r in kept.groupBy("task").count().collect()} <= set(range(5_000, 12_500))
    listing = rows.selectExpr("concat('db/', id) AS path", "id AS size")
    assert registry.registry_entries(listing).count() == 25_000


def test_databases_are_not_broadcast(spark):
    """What has a row per database stays on the executors, however small Spark takes it to be."""
    from quayside.plans import status

    mirroring = spark.createDataFrame([(1, "s3://a/1"), (2, "s3://a/2")], "db_key bigint, db_url string")
    applied = spark.createDataFrame([(1, "t", "s3://a/2")], "db_key bigint, target string, destination string")
    resolved = mirroring.selectExpr("*", "array('mirror') AS services", "1L AS compaction_workers_count")
    wanted = status.assignments(resolved, applied)
    parts = [wanted, targets.unmirrored(mirroring, applied), targets.registered_destinations(applied, mirroring)]
    assert [df.count() for df in parts] == [1, 1, 1]
    assert not any("Broadcast" in df._jdf.queryExecution().executedPlan().toString() for df in parts)
