"""Laws of the sync, prune and restore plans on small random catalogs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quayside.catalog.fixtures import Fixtures
from quayside.operators.snapshot import Catalog, manifest_objects, window_objects
from quayside.plans import audits, lag, mirror, restore, retention
from quayside.session import settle, shared_dir
from quayside.streaming.target import TargetLog

NOW = datetime(2024, 6, 1)


def lit_now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")


MANIFEST = "db_key bigint, manifest_id bigint, last_modified timestamp_ntz, replay_after_wal_id bigint, next_wal_sst_id bigint, last_l0_seq bigint"
OBJECT = "db_key bigint, manifest_id bigint, kind string, object_name string"
CHECKPOINT = "db_key bigint, manifest_id bigint, cp_id string, pinned_id bigint, create_time timestamp_ntz, expire_time timestamp_ntz, name string"
LISTED = "db_key bigint, target string, kind string, object_name string, wal_id bigint, last_modified timestamp_ntz"
POLICY = "db_key bigint, target string, keep_s double, min_age_s double"


class World:
    """Databases with growing histories; targets hold a prefix of each."""

    def __init__(self, seed, n_db=8):
        rng = random.Random(seed)
        self.manifests, self.objects, self.checkpoints, self.heads, self.marks = [], [], [], {}, {}
        for db in range(n_db):
            n = rng.randint(2, 12)
            sst, wal = 0, 0
            live = []
            for m in range(1, n + 1):
                sst += rng.randint(0, 3)
                wal += rng.randint(0, 2)
                when = NOW - timedelta(days=(n - m) * 20, hours=rng.randint(0, 10))
                replay = max(0, wal - rng.randint(0, 3))
                self.manifests.append((db, m, when, replay, wal + 1, m * 10))
                names = {f"compacted/{db:02d}{s:024d}.sst" for s in range(max(0, sst - 5), sst)}
                self.objects += [(db, m, "compacted", o) for o in names]
                if rng.random() < 0.5 and m > 1:
                    expire = rng.choice([None, NOW + timedelta(days=9), NOW - timedelta(days=9)])
                    live.append((f"cp{db}-{m}", rng.randint(1, m - 1), when, expire, rng.choice([None, "mirror:t"])))
                live = [c for c in live if rng.random() < 0.8]
                self.checkpoints += [(db, m, *c) for c in live]
            self.heads[db] = n
            self.marks[db] = rng.choice([None, rng.randint(1, n), n])

    def source(self, spark):
        manifests = spark.createDataFrame(self.manifests, MANIFEST)
        objects = spark.createDataFrame(self.objects, OBJECT).unionByName(window_objects(manifests))
        return Catalog(manifests, objects, spark.createDataFrame(self.checkpoints, CHECKPOINT))


def at_target(source, have):
    """The part of the source catalog whose manifests the target has."""
    def pick(df):
        return df.join(have, ["db_key", "manifest_id"])

    return Catalog(pick(source.manifests).withColumn("readable", F.lit(True)), pick(source.objects), pick(source.checkpoints))


def listing_of(spark, catalog):
    names = catalog.objects.select("db_key", "target", "kind", "object_name").distinct()
    wal = F.when(F.col("kind") == "wal", F.regexp_extract("object_name", r"(\d+)\.sst", 1).cast("bigint"))
    return names.withColumn("wal_id", wal).withColumn("last_modified", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def rows(spark, df):
    """The frame with its rows fixed, so later steps start from short plans."""
    return spark.createDataFrame(df.collect(), df.schema)


def settled(spark, catalog):
    return Catalog(rows(spark, catalog.manifests), rows(spark, catalog.objects), rows(spark, catalog.checkpoints))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_synced_target_is_complete_and_stays_complete_after_a_prune(spark, seed):
    world = World(seed)
    source = settled(spark, world.source(spark))
    # Start: a complete target at its watermark, the closure of that manifest.
    start = []
    for db, mark in world.marks.items():
        if mark is not None:
            start.append((db, "t", mark))
            start += [(db, "t", c[3]) for c in world.checkpoints if c[0] == db and c[1] == mark and (c[5] is None or c[5] > NOW)]
    have = spark.createDataFrame(sorted(set(start)), "db_key bigint, target string, manifest_id bigint")
    dest = settled(spark, at_target(source, have))
    listing = rows(spark, listing_of(spark, dest))
    pairs = spark.createDataFrame([(db, "t", ["builtin", "external", "rclone"][db % 3]) for db in world.heads], "db_key bigint, target string, copier string")

    plan = mirror.sync_plan(source, dest, listing, pairs, lit_now())
    classes = {r.db_key: r["class"] for r in plan.pairs.collect()}
    for db, mark in world.marks.items():
        assert (classes[db] == "caught up") == (mark == world.heads[db])
    commits = plan.commits.collect()
    for db in {r.db_key for r in commits}:
        mine = sorted((r.commit_seq, r.manifest_id) for r in commits if r.db_key == db)
        assert [s for s, _ in mine] == list(range(1, len(mine) + 1))
        assert [m for _, m in mine] == sorted(m for _, m in mine)
        assert mine[-1][1] == world.heads[db]

    committed = plan.commits.select("db_key", "target", "manifest_id")
    dest2 = settled(spark, at_target(source, have.unionByName(committed).distinct()))
    copied = plan.copies.withColumn("wal_id", F.when(F.col("kind") == "wal", F.regexp_extract("object_name", r"(\d+)\.sst", 1).cast("bigint"))).withColumn(
        "last_modified", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    listing2 = rows(spark, listing.unionByName(copied.select(listing.columns)).dropDuplicates(["db_key", "kind", "object_name"]))
    assert audits.completeness_problems(source, dest2, listing2, lit_now()).collect() == []

    again = mirror.sync_plan(source, dest2, listing2, pairs, lit_now())
    assert {r["class"] for r in again.pairs.collect()} == {"caught up"}

    policy = pairs.select("db_key", "target", F.lit(86400.0 * 30).alias("keep_s"), F.lit(300.0).alias("min_age_s"))
    decisions = retention.prune_plan(source, dest2, listing2, policy, lit_now())
    kept = rows(spark, decisions.filter("decision = 'keep'"))
    left = kept.filter("kind = 'manifest'").select("db_key", "target", F.regexp_extract("object_name", r"(\d+)", 1).cast("bigint").alias("manifest_id"))
    dest3 = settled(spark, at_target(source, left))
    listing3 = listing2.join(kept.select("db_key", "kind", "object_name"), ["db_key", "kind", "object_name"], "left_semi")
    assert audits.completeness_problems(source, dest3, listing3, lit_now()).collect() == []
    assert {r.db_key: r.m for r in dest3.manifests.groupBy("db_key").agg(F.max("manifest_id").alias("m")).collect()} == world.heads


@pytest.fixture(scope="module")
def tiny(spark):
    """One database, three manifests; 3 pins 1 through a live checkpoint."""
    day = timedelta(days=1)
    manifests = spark.createDataFrame(
        [(1, 1, NOW - 90 * day, 0, 1, 10), (1, 2, NOW - 60 * day, 0, 1, 20), (1, 3, NOW - 50 * day, 4, 7, 30)], MANIFEST)
    objects = spark.createDataFrame(
        [(1, 1, "compacted", "compacted/a.sst"), (1, 2, "compacted", "compacted/b.sst"), (1, 3, "compacted", "compacted/c.sst")], OBJECT)
    cps = spark.createDataFrame(
        [(1, 3, "live", 1, NOW - 80 * day, None, None), (1, 3, "old", 2, NOW - 80 * day, NOW - day, None)], CHECKPOINT)
    return Catalog(manifests, objects.unionByName(window_objects(manifests)), cps)


def decide(spark, source, dest, listed, keep=86400.0 * 55):
    policy = spark.createDataFrame([(1, "t", keep, 300.0)], POLICY)
    out = retention.prune_plan(source, dest, spark.createDataFrame(listed, LISTED), policy, lit_now())
    return {r.object_name: (r.decision, r.reason) for r in out.collect()}


def test_retention_guards(spark, tiny):
    dest = at_target(tiny, spark.createDataFrame([(1, "t", i) for i in (1, 2, 3)], "db_key bigint, target string, manifest_id bigint"))
    old, fresh = NOW - timedelta(days=70), NOW - timedelta(seconds=300)
    listed = [(1, "t", "compacted", f"compacted/{x}.sst", None, old) for x in "abz"] + [
        (1, "t", "compacted", "compacted/young.sst", None, fresh),
        (1, "t", "wal", "wal/00000000000000000007.sst", 7, old), (1, "t", "wal", "wal/00000000000000000002.sst", 2, old)]
    got = decide(spark, tiny, dest, listed)
    name = "manifest/{:020d}.manifest".format
    assert got[name(3)][0] == got[name(1)][0] == "keep" and got[name(2)] == ("delete", "expired")
    assert got["compacted/a.sst"] == ("keep", "referenced by a kept manifest")
    # The expired checkpoint still spares its manifest's objects at the source.
    assert got["compacted/b.sst"] == ("keep", "in the source's closure")
    assert got["compacted/z.sst"] == ("delete", "unreferenced")
    assert got["compacted/young.sst"] == ("keep", "too young")
    assert got["wal/00000000000000000007.sst"] == ("keep", "WAL tail")
    assert got["wal/00000000000000000002.sst"] == ("delete", "unreferenced")


def test_retention_holds_data_back_when_it_cannot_know(spark, tiny):
    ids = spark.createDataFrame([(1, "t", i) for i in (1, 2, 3)], "db_key bigint, target string, manifest_id bigint")
    dest = at_target(tiny, ids)
    listed = [(1, "t", "compacted", "compacted/z.sst", None, NOW - timedelta(days=70))]
    gone = Catalog(tiny.manifests.limit(0), tiny.objects.limit(0), tiny.checkpoints.limit(0))
    assert decide(spark, gone, dest, listed)["compacted/z.sst"] == ("keep", "source unreachable")
    torn = Catalog(dest.manifests.withColumn("readable", F.col("manifest_id") != 1), dest.objects, dest.checkpoints)
    got = decide(spark, tiny, torn, listed)
    assert got["compacted/z.sst"] == ("keep", "a kept manifest is unreadable")
    assert got["manifest/00000000000000000002.manifest"][0] == "delete"
    assert decide(spark, tiny, dest, listed, None) == {}


def test_retention_respects_the_oldest_pin(spark, tiny):
    dest = at_target(tiny, spark.createDataFrame([(1, "t", 3)], "db_key bigint, target string, manifest_id bigint"))
    named = tiny.checkpoints.withColumn("name", F.lit("mirror:t"))
    source = Catalog(tiny.manifests, tiny.objects, named)
    edge = NOW - timedelta(days=80, seconds=300)
    listed = [(1, "t", "compacted", "compacted/at.sst", None, edge), (1, "t", "compacted", "compacted/before.sst", None, edge - timedelta(seconds=1))]
    got = decide(spark, source, dest, listed)
    assert got["compacted/at.sst"] == ("keep", "newer than the oldest pin")
    assert got["compacted/before.sst"] == ("delete", "unreferenced")


def test_sync_restarts_when_a_pinned_manifest_is_gone(spark, tiny):
    source = Catalog(tiny.manifests.filter("manifest_id <> 1"), tiny.objects, tiny.checkpoints)
    dest = at_target(tiny, spark.createDataFrame([], "db_key bigint, target string, manifest_id bigint"))
    pairs = spark.createDataFrame([(1, "t", "builtin"), (9, "t", "builtin")], "db_key bigint, target string, copier string")
    plan = mirror.sync_plan(source, dest, spark.createDataFrame([], LISTED), pairs, lit_now())
    assert {r.db_key: r["class"] for r in plan.pairs.collect()} == {1: "restart", 9: "no manifests at the source"}
    assert plan.copies.count() == plan.commits.count() == 0


def test_restore_requests(spark, tiny):
    ts = [(1, 10, NOW - timedelta(days=90)), (1, 25, NOW - timedelta(days=55))]
    samples = spark.createDataFrame(ts, "db_key bigint, seq bigint, ts timestamp_ntz")
    asked = [("new", 1, "d1", "latest", None, None), ("two", 1, "d2", "id", 2, None), ("no", 1, "d3", "id", 8, None),
             ("then", 1, "d4", "time", None, NOW - timedelta(days=60)), ("ever", 1, "d5", "time", None, NOW - timedelta(days=365)),
             ("full", 1, "d6", "latest", None, None), ("who", 7, "d7", "latest", None, None)]
    requests = spark.createDataFrame(asked, "request_id string, db_key bigint, dest string, mode string, want_id bigint, at timestamp_ntz")
    occupied = spark.createDataFrame([("d6",)], "dest string")
    plan = restore.restore_plan(tiny, requests, samples, occupied, lit_now())
    got = {r.request_id: (r.manifest_id, r.manifests_committed, r.copied_objects, r.error) for r in plan.outcomes.collect()}
    assert got == {
        "new": (3, 2, 4, None), "two": (2, 1, 1, None), "no": (None, 0, 0, "manifest unknown"), "then": (2, 1, 1, None),
        "ever": (None, 0, 0, "earlier than the first recorded time"), "full": (None, 0, 0, "target holds data already"), "who": (None, 0, 0, "no manifests at the source"),
    }
    partial = Catalog(tiny.manifests.filter("manifest_id <> 1"), tiny.objects, tiny.checkpoints)
    plan = restore.restore_plan(partial, requests, samples, occupied, lit_now())
    assert {r.request_id: r.error for r in plan.outcomes.collect()}["new"] == "kept for others only, cannot be restored"


def test_lag_of_an_empty_target_is_the_head_id(spark, tiny):
    pairs = spark.createDataFrame([(1, "t"), (2, "t")], "db_key bigint, target string")
    dest = at_target(tiny, spark.createDataFrame([], "db_key bigint, target string, manifest_id bigint"))
    wals = spark.createDataFrame([(1, 6)], "db_key bigint, wal_id bigint")
    samples = spark.createDataFrame([(1, 10, NOW)], "db_key bigint, seq bigint, ts timestamp_ntz")
    got = lag.mirror_lag(pairs, tiny.manifests, dest.manifests, wals, wals.withColumn("target", F.lit("t")).limit(0), samples)
    rows_ = {r.db_key: r for r in got.collect()}
    assert (rows_[1].manifests_behind, rows_[1].wal_behind, rows_[1].error) == (3, None, None)
    assert rows_[2].error == "source has no manifest" and rows_[2].source_manifest_id is None


def test_nested_manifests(spark):
    view = "struct<ulid:string,wal_id:bigint>"
    schema = f"db_key bigint, manifest_id bigint, l0 array<{view}>, runs array<struct<ssts:array<{view}>>>, segments array<struct<l0:array<{view}>,runs:array<struct<ssts:array<{view}>>>>>, replay_after_wal_id bigint, next_wal_sst_id bigint"
    row = (1, 5, [("A", None), (None, 9)], [([("A", None), ("B", None)],), ([],)], [([("C", None)], [([("D", None)],)])], 7, 11)
    empty = (1, 6, [], [], [], 7, 8)
    got = {(r.manifest_id, r.object_name) for r in manifest_objects(spark.createDataFrame([row, empty], schema)).collect()}
    wal = "wal/{:020d}.sst".format
    assert got == {(5, f"compacted/{x}.sst") for x in "ABCD"} | {(5, wal(i)) for i in (8, 9, 10)}


def test_deletes_alone_are_those_among_all_decisions(spark):
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    now, policy = fx.mirror_now, fx.retention_policy
    dest, listing = (settle(rows, "test") for rows in (fx.dest.manifests, fx.dst_object))
    dest = Catalog(dest, fx.dest.objects, fx.dest.checkpoints)
    rows = lambda df: sorted(df.collect(), key=repr)
    every = retention.prune_plan(fx.source, dest, listing, policy, now)
    only = rows(retention.prune_plan(fx.source, dest, listing, policy, now, only_deletes=True).filter("decision = 'delete'"))
    assert only == rows(every.filter("decision = 'delete'"))
    assert {r.kind for r in only} == {"manifest", "compacted", "wal"}


def test_a_target_without_removals_is_taken_as_it_is(spark):
    """Nothing is joined to find what belongs to a removed manifest as long as none is removed."""
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    dest = Catalog(*(settle(df, "test") for df in (fx.dest.manifests, fx.dest.objects, fx.dest.checkpoints)))
    target = TargetLog(spark, shared_dir(spark, "target"), dest, settle(fx.dst_object, "test"))
    catalog, listing = target.state(-1, -1)
    for df in (catalog.objects, catalog.checkpoints, listing):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
