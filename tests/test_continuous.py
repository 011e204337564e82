"""Jobs that go on where they were: the mirror batch by batch, and the cuts of a whole history."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from test_mirror import World, at_target, listing_of, lit_now, rows, settled

from quayside.operators import placement
from quayside.operators.snapshot import Catalog
from quayside.plans import mirror, retention
from quayside.session import shared_dir
from quayside.streaming.handoff import HandoffStream
from quayside.streaming.mirror import ContinuousMirror
from quayside.streaming.periodic import cut_history

PAIR = ["db_key", "target"]


def key_rows(df, *names):
    found = [tuple(r) for r in df.select(*PAIR, *names).collect()]
    assert len(found) == len(set(found))
    return sorted(found)


def recomputed(spark, source, dest, listing, pairs, policy, wals):
    """A pass, its tail and a prune over whole catalogs: the new state, and what was committed and copied."""
    plan = mirror.sync_plan(source, dest, listing, pairs, lit_now())
    commits = rows(spark, plan.commits.join(dest.manifests, [*PAIR, "manifest_id"], "left_anti"))
    copies = rows(spark, plan.copies.join(listing, [*PAIR, "kind", "object_name"], "left_anti"))
    dest, listing = mirror.committed_state(source, dest, listing, commits, copies, lit_now())
    dest, listing = settled(spark, dest), rows(spark, listing)
    tops = {}
    for r in dest.manifests.collect():
        tops[r.db_key] = max(tops.get(r.db_key, (0, 0)), (r.manifest_id, r.next_wal_sst_id))
    tails, added = [], []
    for (db,) in pairs.select("db_key").collect():
        if db in tops:
            last = [r.wal_id for r in listing.filter(f"db_key = {db} AND kind = 'wal'").collect()]
            start = end = max(tops[db][1], max(last, default=-1) + 1)
            while (db, end) in wals:
                added.append((db, "t", "wal", f"wal/{end:020d}.sst", end))
                end += 1
            tails += [(db, "t", start, end - 1)] if end > start else []
    decisions = retention.prune_plan(source, dest, listing, policy, lit_now())
    gone = rows(spark, decisions.filter("decision = 'delete'"))
    dead = gone.filter("kind = 'manifest'").select(*PAIR, F.regexp_extract("object_name", r"(\d+)", 1).cast("bigint").alias("manifest_id"))
    if added:
        more = spark.createDataFrame(added, "db_key bigint, target string, kind string, object_name string, wal_id bigint")
        listing = listing.unionByName(more.withColumn("last_modified", lit_now()))
    listing = rows(spark, listing.join(gone, [*PAIR, "kind", "object_name"], "left_anti"))
    kept = settled(spark, Catalog(*(df.join(dead, [*PAIR, "manifest_id"], "left_anti") for df in (dest.manifests, dest.objects, dest.checkpoints))))
    return kept, listing, commits, copies, tails


def test_batches_equal_recomputing_everything(spark):
    world = World(11, n_db=5)
    source = settled(spark, world.source(spark))
    have = spark.createDataFrame([(db, "t", mark) for db, mark in world.marks.items() if mark == 1] or [(0, "t", 1)], "db_key bigint, target string, manifest_id bigint")
    dest = settled(spark, at_target(source, have))
    listing = rows(spark, listing_of(spark, dest))
    pairs = spark.createDataFrame([(db, "t", ["builtin", "external", "rclone"][db % 3]) for db in world.heads], "db_key bigint, target string, copier string")
    policy = pairs.select(*PAIR, F.lit(86400.0 * 40).alias("keep_s"), F.lit(300.0).alias("min_age_s"))
    wals = {(db, i) for db in world.heads for i in range(40) if i != 30}
    wal_rows = spark.createDataFrame(sorted(wals), "db_key bigint, wal_id bigint")
    job = ContinuousMirror(spark, shared_dir(spark, "continuous-test"), source, dest, listing, pairs, lit_now(), policy, wal_rows, fold_batches=2)

    dice = random.Random(1)
    newest = {db: 0 for db in world.heads}
    for batch_id in range(3):
        news = {db: min(world.heads[db], newest[db] + dice.randint(1, 4)) for db in world.heads if dice.random() < 0.8 or batch_id == 0}
        newest |= news
        batch = spark.createDataFrame([(db, m) for db, top in news.items() for m in range(1, top + 1)], "db_key bigint, manifest_id bigint")
        job(batch, batch_id)
        if batch_id == 1:
            job(batch, batch_id)

        marks = spark.createDataFrame(list(news.items()), "db_key bigint, newest bigint")
        seen = Catalog(*(df.join(marks, "db_key").filter("manifest_id <= newest").drop("newest") for df in (source.manifests, source.objects, source.checkpoints)))
        touched = pairs.join(marks, "db_key").select(pairs.columns)
        dest, listing, commits, copies, tails = recomputed(spark, seen, dest, listing, touched, policy.join(marks, "db_key").select(policy.columns), wals)

        snapshot, _ = job.target.snapshot_before(batch_id + 1)
        catalog, listed = job.target.state(batch_id, snapshot)
        assert key_rows(catalog.manifests, "manifest_id") == key_rows(dest.manifests, "manifest_id")
        assert key_rows(catalog.objects, "manifest_id", "object_name") == key_rows(dest.objects, "manifest_id", "object_name")
        assert key_rows(catalog.checkpoints, "manifest_id", "cp_id") == key_rows(dest.checkpoints, "manifest_id", "cp_id")
        assert key_rows(listed, "kind", "object_name") == key_rows(listing, "kind", "object_name")
        mine = F.col("micro_batch") == batch_id
        assert key_rows(job.log("commits").filter(mine), "manifest_id") == key_rows(commits, "manifest_id")
        assert key_rows(job.log("copies").filter(mine), "object_name") == key_rows(copies, "object_name")
        assert key_rows(job.log("tails").filter(mine), "from_id", "to_id") == sorted(tails)
    # The second batch, though it ran twice, has been folded into a snapshot.
    assert snapshot == 1 and job.log("tails").count() and job.log("deletes").count()


def test_handoffs_equal_ranking_the_whole_fleet(spark):
    dice = random.Random(9)
    services = ["gc", "mirror", "compaction-workers"]
    wanted = spark.createDataFrame(
        [(f"s3://d/{i}", s, "t" if s == "mirror" else None, 3 if s == "compaction-workers" else 1) for i in range(25) for s in services],
        "db_url string, service string, target string, k int")
    job = HandoffStream(spark, shared_dir(spark, "handoff-test"), wanted, full_every=2)
    fleet, owned = {}, {}
    for batch_id in range(4):
        changes = []
        for node in dice.sample(range(12), 12 if batch_id == 0 else 4):
            name = f"n{node}"
            offered = sorted(dice.sample(services, dice.randint(0, 3)))
            if name in fleet and dice.random() < 0.5:
                changes.append((name, "down", 1, fleet.pop(name)))
            else:
                changes += [(name, "up", 0, services), (name, "role" if name in fleet else "up", 1, offered)]
                fleet[name] = offered
        job(spark.createDataFrame(changes, "node_id string, change string, at int, services array<string>"), batch_id)
        live = spark.createDataFrame(list(fleet.items()), "node_id string, services array<string>")
        ranked = {(r.db_url, r.service): r.owners for r in placement.rank_nodes(wanted, live).collect()}
        assert {(r.db_url, r.service): r.owners for r in job.owners(batch_id).collect()} == ranked
        now = {key: {o.node_id for o in owners} for key, owners in ranked.items()}
        want = {(key, tuple(sorted(owned.get(key, set()) - now[key])), tuple(sorted(now[key] - owned.get(key, set())))) for key in now if now[key] != owned.get(key, set())}
        got = job.events().filter(F.col("micro_batch") == batch_id).collect()
        assert {((r.db_url, r.service), tuple(r.lost), tuple(r.gained)) for r in got} == want and len(got) == len(want)
        owned = now


def test_cuts_are_those_of_going_through_the_history(spark):
    dice = random.Random(2)
    history, want = [], []
    begin = datetime(2024, 1, 1)
    for db, spread in ((1, 1), (2, 50), (3, 2000), (4, 1)):
        at = begin
        for number in range(150 if db != 4 else 1):
            at += timedelta(seconds=dice.choice([0, 1, 3, spread, spread * 40 if number % 30 == 7 else spread]))
            history.append((db, number, at))
    pairs = [(1, "a", 10.0), (1, "b", 0.5), (2, "a", 300.0), (3, "a", 1.0), (3, "b", 0.0), (4, "a", 60.0), (9, "a", 60.0)]
    for db, target, interval in pairs:
        newest, last = {}, None
        for _, number, at in (row for row in history if row[0] == db):
            newest[at] = number
        for at in sorted(newest):
            if last is None or (at - last).total_seconds() >= interval:
                want.append((db, target, newest[at], at))
                last = at
    manifests = spark.createDataFrame(history, "db_key bigint, manifest_id bigint, last_modified timestamp_ntz").repartition(3)
    cuts = cut_history(manifests, spark.createDataFrame(pairs, "db_key bigint, target string, interval_s double"))
    assert sorted(tuple(r) for r in cuts.collect()) == sorted(want)
