import glob
import os
import random
import time
from datetime import datetime

from pyspark.sql import functions as F

from quayside.session import shared_dir
from quayside.sinks import commit, objects
from quayside.sources import documents, listings
from quayside.streaming.leases import lapsed_passes, lease_periods
from quayside.streaming import keyed
from quayside.streaming.keyed import run_keyed
from quayside.streaming.liveness import liveness_changes
from quayside.streaming.settings import settings_changes, settings_view
from quayside.streaming.tail import tailed_runs

IDS = "db_key bigint, target string, wal_id bigint"


class Feed:
    """A stream of files that are added step by step; each step runs to its end and gives what it emitted."""

    def __init__(self, spark, build, *schemas):
        self.spark, self.build, self.schemas = spark, build, schemas
        self.path = shared_dir(spark, "feed-test")
        for number, schema in enumerate(schemas):
            spark.createDataFrame([], schema).write.parquet(f"{self.path}/in{number}")
        self.before = []

    def __call__(self, *inputs):
        for number, rows in enumerate(inputs):
            self.spark.createDataFrame(rows, self.schemas[number]).coalesce(1).write.mode("append").parquet(f"{self.path}/in{number}")
        streams = [self.spark.readStream.schema(schema).parquet(f"{self.path}/in{n}") for n, schema in enumerate(self.schemas)]
        out = run_keyed(self.build(*streams), f"{self.path}/out", f"{self.path}/checkpoint").collect()
        fresh = list(out)
        for row in self.before:
            fresh.remove(row)
        self.before = out
        return fresh


def test_tail_waits_for_gaps_and_drops_duplicates(spark):
    feed = Feed(spark, lambda ids, floors: tailed_runs(ids, floors, width=4), IDS, "db_key bigint, target string, floor bigint")

    def step(ids, floors=()):
        runs = feed([(d, "t", i) for d, i in ids], [(d, "t", f) for d, f in floors])
        return sorted((r.db_key, r.from_id, r.to_id) for r in runs)

    assert step([(1, 6), (1, 4), (2, 1)], [(1, 5), (2, 0)]) == []
    # Ids of a log without a floor wait.
    assert step([(1, 5), (1, 5), (1, 9), (3, 1), (3, -3)]) == [(1, 5, 6)]
    assert step([(1, 6), (1, 7), (1, 8), (2, 0)]) == [(1, 7, 9), (2, 0, 1)]
    # A commit raised the floor past a hole; a lower floor changes nothing.
    assert step([(1, 11), (1, 20)], [(1, 20), (2, 1), (3, -3)]) == [(1, 20, 20), (3, -3, -3)]
    assert step([(3, i) for i in range(-2, 30)] + [(1, 12), (2, 2)], [(1, 19)]) == [(2, 2, 2), (3, -2, 29)]
    assert step([(3, i) for i in range(40)]) == [(3, 30, 39)]


def test_tail_in_any_order_is_the_dense_run(spark):
    dice = random.Random(8)
    feed = Feed(spark, lambda ids, floors: tailed_runs(ids, floors, width=16), IDS, "db_key bigint, target string, floor bigint")
    ids = [(d, "t", i) for d in (1, 2) for i in range(200) if (d, i) != (2, 150)] * 2
    dice.shuffle(ids)
    got = []
    for at in range(0, len(ids), 270):
        runs = feed(ids[at : at + 270], [(1, "t", 3), (2, "t", 0)] if at == 270 else [])
        got += [(r.db_key, i) for r in runs for i in range(r.from_id, r.to_id + 1)]
    assert sorted(got) == [(1, i) for i in range(3, 200)] + [(2, i) for i in range(150)]


def test_a_range_with_many_holes_hands_on_two_runs(spark):
    """What waits at a log's front is bounded by its ranges and floors, not by the holes in them."""
    from quayside.operators.ordered import RANGE_WIDTH

    ids = spark.createDataFrame([(1, "t", i) for i in range(0, 3000) if i % 3], IDS).coalesce(1)
    path = shared_dir(spark, "holes-test")
    ids.write.parquet(f"{path}/in")
    spark.createDataFrame([(1, "t", 1), (1, "t", 1000)], "db_key bigint, target string, floor bigint").write.parquet(f"{path}/floors")
    stream = tailed_runs(spark.readStream.schema(ids.schema).parquet(f"{path}/in"),
                         spark.readStream.schema("db_key bigint, target string, floor bigint").parquet(f"{path}/floors"))
    out = run_keyed(stream, f"{path}/out", f"{path}/checkpoint").collect()
    assert [(r.from_id, r.to_id) for r in out] == [(1000, 1001)] and RANGE_WIDTH > 3000
    told = spark.read.format("statestore").option("operatorId", 1).option("stateVarName", "range").load(f"{path}/checkpoint").collect()
    assert len(told) == 1
    waiting = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "waiting").load(f"{path}/checkpoint").collect()
    assert len(waiting) == 0


BEATS = "node_id string, services array<string>, last_modified timestamp, location string, deleted boolean"


def test_changes_by_the_time_of_the_stream(spark):
    feed = Feed(spark, lambda beats: liveness_changes(beats, 30, "0 seconds"), BEATS)

    def step(*rows):
        out = feed([(n, s, datetime(2024, 1, 1, 0, t // 60, t % 60), f"nodes/{n}", d) for n, s, t, d in rows])
        return sorted((r.node_id, r.change, r.at.minute * 60 + r.at.second, r.services) for r in out)

    assert step(("a", ["gc"], 5, False), ("b", [], 8, False)) == [("a", "up", 5, ["gc"]), ("b", "up", 8, [])]
    # A row of the same batch that is older is no change; the roles of the youngest count.
    assert step(("a", ["mirror"], 15, False), ("a", ["gc"], 12, False), ("b", [], 20, False)) == [("a", "role", 15, ["mirror"])]
    assert step(("b", [], 29, True)) == [("b", "down", 29, [])]
    # Only the clock moves on, to just before and then to the end of the timeout.
    assert step(("", [], 44, False)) == []
    assert step(("", [], 45, False)) == [("a", "down", 45, ["mirror"])]
    # Back after a silence that nobody has looked at, and gone again within one batch.
    assert step(("b", [], 50, False), ("b", [], 80, False), ("b", ["gc"], 115, False)) == [
        ("b", "down", 80, []), ("b", "down", 110, []), ("b", "up", 50, []), ("b", "up", 80, []), ("b", "up", 115, ["gc"])]
    assert step(("a", ["gc"], 300, True), (None, [], 300, False)) == [("b", "down", 145, ["gc"])]


def test_late_heartbeats_are_held_against_what_is_known(spark):
    feed = Feed(spark, lambda beats: liveness_changes(beats, 30, "1 hour"), BEATS)

    def step(*rows):
        out = feed([("a", ["gc"], datetime(2024, 1, 1, 0, t // 60, t % 60), "l", d) for t, d in rows])
        return sorted((r.change, r.at.minute * 60 + r.at.second) for r in out)

    assert step((100, False)) == [("up", 100)]
    assert step((95, True), (100, True), (120, False)) == []
    assert step((110, True)) == []
    assert step((149, False)) == []
    assert step((200, False)) == [("down", 179), ("up", 200)]


def test_a_silent_node_goes_down_without_any_row(spark):
    path = shared_dir(spark, "silent-test")
    row = spark.createDataFrame([("a", ["gc"], "l", False)], "node_id string, services array<string>, location string, deleted boolean")
    row.withColumn("last_modified", F.current_timestamp()).write.parquet(f"{path}/in")
    query = keyed.start(
        liveness_changes(spark.readStream.schema(BEATS).parquet(f"{path}/in"), 12), f"{path}/out", f"{path}/checkpoint",
        processingTime="1 second",
    )
    try:
        for _ in range(60):
            time.sleep(1)
            out = spark.read.parquet(f"{path}/out").collect() if glob.glob(f"{path}/out/*.parquet") else []
            if len(out) > 1:
                break
    finally:
        query.stop()
    up, down = sorted(out, key=lambda r: r.at)
    assert (up.change, down.change, (down.at - up.at).total_seconds()) == ("up", "down", 12)


def test_settings_keep_the_last_good_version(spark):
    feed = Feed(spark, settings_changes, "key string, version bigint, valid boolean, payload string")

    def step(*rows):
        return sorted((r.key, r.latest, r.used, r.payload) for r in feed(list(rows)))

    assert step(("a", 1, True, "x"), ("b", 1, False, "y"), ("a", 3, False, "z")) == [("a", 3, 1, "x"), ("b", 1, None, None)]
    # Known, older or void versions change nothing.
    assert step(("a", 1, True, "x"), ("a", 2, False, "q"), ("b", 0, False, None), (None, 9, True, "n"), ("a", None, True, "n")) == []
    assert step(("a", 2, True, "late"), ("b", 2, True, None), ("c", 5, True, "c"), ("c", 5, True, "d")) == [
        ("a", 3, 2, "late"), ("b", 2, 2, None), ("c", 5, 5, "d")]
    view = settings_view(spark.createDataFrame(feed.before))
    assert {(r.key, r.used_version, r.payload, r.disabled, r.warning is None) for r in view.collect()} == {
        ("a", 2, "late", False, False), ("b", 2, None, False, True), ("c", 5, "d", False, True)}


def test_what_a_batch_writes_follows_the_batch(spark):
    feed = Feed(spark, settings_changes, "key string, version bigint, valid boolean, payload string")
    held = lambda: {f: os.path.getsize(f) for f in glob.glob(f"{feed.path.removeprefix('file://')}/checkpoint/state/**/*.changelog", recursive=True)}
    feed([(f"key{i}", 1, True, "some payload " * 10) for i in range(4000)])
    many = held()
    feed([("key7", 2, True, "another")])
    one = {f: size for f, size in held().items() if f not in many}
    assert many and one and sum(one.values()) * 20 < sum(many.values())


def test_leases_lapse(spark):
    def at(second):
        return datetime(2024, 1, 1, 0, 0, second)

    refreshes = spark.createDataFrame([("p", at(0)), ("p", at(9)), ("p", at(19)), ("p", at(25))], "pin_id string, ts timestamp")
    periods = lease_periods(refreshes, 10)
    got = sorted((r.held_from.second, r.lapses_at.second, r.refreshes) for r in periods.collect())
    assert got == [(0, 19, 2), (19, 35, 2)]
    passes = spark.createDataFrame([("p", at(1), at(18)), ("p", at(1), at(19)), ("q", at(1), at(2))], "pin_id string, started_at timestamp, ended_at timestamp")
    assert {(r.pin_id, r.ended_at.second) for r in lapsed_passes(passes, periods).collect()} == {("p", 19), ("q", 2)}


def test_objects_are_written_listed_copied_and_deleted(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([("wal/1.sst", b"abc"), ("compacted/x.sst", b""), ("wal/2.sst", b"z" * 100)], "object_name string, content binary")
    assert objects.put_objects(rows, f"{root}/src").count() == 3
    roots = spark.createDataFrame([(f"{root}/src",), (f"{root}/nothing",)], "root string")
    listed = listings.list_objects(roots).collect()
    assert sorted((r.path.removeprefix(f"{root}/src/"), r["size"]) for r in listed) == [
        ("compacted/x.sst", 0), ("wal/1.sst", 3), ("wal/2.sst", 100)]
    assert all(r.last_modified for r in listed)

    plan = rows.select("object_name").unionByName(spark.createDataFrame([("wal/none.sst",)], "object_name string"))
    copied = spark.createDataFrame(objects.copy_objects(plan, f"{root}/src", f"{root}/dst", 2).collect(), "name string, bytes bigint, error string")
    totals = objects.copied_totals(copied).first()
    assert (totals.objects, totals.bytes, totals.failed) == (3, 103, 1)
    assert (tmp_path / "dst/wal/2.sst").read_bytes() == b"z" * 100

    paths = spark.createDataFrame([(f"{root}/dst/wal/1.sst",), (f"{root}/dst/wal/none.sst",)], "path string")
    assert {r.deleted for r in objects.delete_objects(paths).collect()} == {False}
    assert (tmp_path / "dst/wal/1.sst").exists()
    assert {r.deleted for r in objects.delete_objects(paths, dry_run=False).collect()} == {True}
    assert not (tmp_path / "dst/wal/1.sst").exists()


def test_a_plan_is_copied_with_the_parallelism_of_each_target(spark, tmp_path):
    root = str(tmp_path)
    names = [f"wal/{i}.sst" for i in range(60)]
    objects.put_objects(spark.createDataFrame([(n, b"x" * i) for i, n in enumerate(names)], "object_name string, content binary"), f"{root}/src").count()
    plan = spark.createDataFrame(
        [(db, t, p, n, f"{root}/src/{n}", f"{root}/{t}/{db}/{n}") for db, t, p in ((1, "slow", 1), (1, "fast", 5), (2, "plain", None)) for n in [*names, "wal/none.sst"]],
        "db_key bigint, target string, copy_parallelism int, object_name string, source string, dest string")
    copied = objects.copy_rows(plan, ["db_key", "target"], tasks=16)
    tasks = copied.withColumn("task", F.spark_partition_id()).groupBy("target").agg(F.count_distinct("task").alias("tasks"))
    spread = {r.target: r.tasks for r in tasks.collect()}
    assert spread["slow"] == 1 and 1 < spread["fast"] <= 5 and 1 < spread["plain"] <= 8
    totals = {(r.db_key, r.target): (r.objects, r.bytes, r.failed) for r in objects.copied_totals(copied, ["db_key", "target"]).collect()}
    assert totals == {key: (60, 1770, 1) for key in ((1, "slow"), (1, "fast"), (2, "plain"))}
    assert (tmp_path / "fast/1/wal/59.sst").read_bytes() == b"x" * 59


def test_one_divergence_stops_its_group_only(spark):
    schema = "db_key bigint, manifest_id bigint, content string"
    source = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "c")], schema)
    target = spark.createDataFrame([(1, 1, "a"), (2, 1, "X")], schema)
    classes = commit.commit_classes(source, target, ["db_key"], "manifest_id")
    assert {(r.db_key, r.manifest_id): r["class"] for r in classes.collect()} == {
        (1, 1): "same", (1, 2): "insert", (2, 1): "diverged", (2, 2): "insert"}
    assert [(r.db_key, r.manifest_id) for r in commit.rows_to_insert(classes, ["db_key"]).collect()] == [(1, 2)]


def test_documents_to_read(spark):
    listing = spark.createDataFrame([("a", 0, "1"), ("b", 5, "1"), ("c", 5, "2"), ("d", 5, None)], "path string, size bigint, etag string")
    known = spark.createDataFrame([("b", "1"), ("c", "1"), ("d", None)], "path string, etag string")
    assert {r.path for r in documents.documents_to_read(listing, known).collect()} == {"c", "d"}
