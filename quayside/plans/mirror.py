"""Incremental mirroring: what every (database, target) must copy and commit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.names import object_class
from quayside.operators import intervals
from quayside.operators.ordered import row_number_by
from quayside.operators.sets import looked_up
from quayside.operators.snapshot import (
    Catalog, closure_members, heads, live_pins, member_objects, window_runs,
)
from quayside.session import settle

PAIR = ["db_key", "target"]
PAIR_KEYS = ("db_key", "target")


@dataclass(frozen=True)
class SyncPlan:
    """``pairs``    (db_key, target, class, seeding, head, watermark, next_wal_sst_id)
    ``copies``   (db_key, target, kind, object_name)
    ``commits``  (db_key, target, manifest_id, commit_seq), the head last
    """

    pairs: DataFrame
    copies: DataFrame
    commits: DataFrame


def pair_states(source: DataFrame, dest: DataFrame, pairs: DataFrame) -> DataFrame:
    """Compare each pair's source head with its target's watermark.

    ``state`` is NULL where there is something to do. ``source`` may carry an
    ``exclusion_reason`` column.
    """
    head_columns = ["db_key", F.col("manifest_id").alias("head"), "next_wal_sst_id"]
    source_heads = heads(source)
    if "exclusion_reason" in source.columns:
        head_columns.append("exclusion_reason")
    source_heads = source_heads.select(*head_columns)
    if "exclusion_reason" not in source.columns:
        source_heads = source_heads.withColumn("exclusion_reason", F.lit(None).cast("string"))
    marks = dest.groupBy(*PAIR).agg(F.max("manifest_id").alias("watermark"))
    state = (
        F.when(F.col("head").isNull(), F.lit("no manifests at the source"))
        .when(F.col("exclusion_reason").isNotNull(), F.lit("excluded"))
        .when(F.col("watermark") > F.col("head"), F.lit("diverged"))
        .when(F.col("watermark") == F.col("head"), F.lit("caught up"))
    )
    return (
        pairs.join(source_heads, "db_key", "left").join(marks, PAIR, "left")
        .withColumn("state", state)
    )


def present_manifests(source: Catalog, dest: Catalog, pending: DataFrame, members: DataFrame,
                      now: Column) -> DataFrame:
    """(db_key, target, manifest_id) known to be at the target without listing it.

    That is the watermark, and what a checkpoint pins that is live in both the
    watermark and the head. Checkpoint ids are matched, not the manifests they
    pin. Commits are complete, so these manifests' objects are there too.
    """
    marks = watermarks(pending)
    roots = pending.select("db_key", F.col("head").alias("manifest_id")).distinct()
    live_in_head = live_pins(source.checkpoints, roots, now).select("db_key", "cp_id")
    shared = (
        live_pins(dest.checkpoints, marks, now, PAIR_KEYS)
        .join(live_in_head, ["db_key", "cp_id"], "left_semi")
        .select(*PAIR, F.col("pinned_id").alias("manifest_id"))
        .join(
            members.select("db_key", F.col("member_id").alias("manifest_id")),
            ["db_key", "manifest_id"], "left_semi",
        )
    )
    return marks.unionByName(shared).distinct()


def watermarks(pending: DataFrame) -> DataFrame:
    return pending.filter(F.col("watermark").isNotNull()).select(
        *PAIR, F.col("watermark").alias("manifest_id")
    )


def unproven_objects(source: Catalog, dest: Catalog, ready: DataFrame, members: DataFrame,
                     present: DataFrame) -> DataFrame:
    """(db_key, target, copier, kind, object_name): closure objects that may be missing.

    One pass over the members' objects marks those some present member holds;
    only what is left is compared with the watermark's own objects.
    """
    there = present.select(*PAIR, F.col("manifest_id").alias("member_id"), F.lit(True).alias("_there"))
    unmarked = (
        member_objects(members, source.objects)
        .join(ready.select(*PAIR, "copier"), "db_key")
        .join(there, [*PAIR, "member_id"], "left")
        .groupBy(*PAIR, "copier", "kind", "object_name").agg(F.max("_there").alias("_there"))
        .filter(F.col("_there").isNull()).drop("_there")
    )
    own = dest.objects.join(watermarks(ready), [*PAIR, "manifest_id"], "left_semi").select(
        *PAIR, "kind", "object_name"
    )
    return unmarked.join(own, [*PAIR, "kind", "object_name"], "left_anti")


def missing_at_target(candidates: DataFrame, listing: DataFrame) -> DataFrame:
    """What of the candidates has to be copied.

    WAL objects are checked against the target's listing for every copier,
    compacted objects only for the ``external`` one: re-copying an immutable
    object is harmless and the other copiers skip the check.
    """
    on = [*PAIR, "kind", "object_name"]
    checked = (F.col("kind") == "wal") | (F.col("copier") == "external")
    there = looked_up(listing, candidates.filter(checked), on).withColumn("_there", F.lit(True))
    return candidates.join(there, on, "left").filter(~checked | F.col("_there").isNull()).drop("_there")


def wal_runs_to_copy(source: DataFrame, dest_listing: DataFrame, ready: DataFrame, members: DataFrame,
                     present: DataFrame) -> DataFrame:
    """(db_key, target, start, end): the windows' WAL ids that a pass copies, as runs.

    The same ids as among the copies of :func:`sync_plan`, where those come from
    windows, without a row per id: the closure's windows less those of
    ``present`` manifests and less what the target lists.
    """
    # Written, so that these few rows are known to be few and the windows are not sent to them.
    windows, present = window_runs(source), settle(present, "present")
    wanted = (
        members.select("db_key", F.col("member_id").alias("manifest_id")).join(windows, ["db_key", "manifest_id"])
        .join(ready.select(*PAIR), "db_key").select(*PAIR, "start", "end")
    )
    held = windows.join(present, ["db_key", "manifest_id"]).select(*PAIR, "start", "end")
    listed = dest_listing.filter(F.col("kind") == "wal").join(ready.select(*PAIR), PAIR, "left_semi")
    return intervals.difference(wanted, held.unionByName(intervals.as_runs(listed, PAIR, "wal_id")), PAIR)


def commit_order(members: DataFrame, keys: list[str]) -> DataFrame:
    """Number the manifests to commit, ascending by id, so the head comes last."""
    return row_number_by(members, keys, "manifest_id", "commit_seq")


def sync_plan(source: Catalog, dest: Catalog, dest_listing: DataFrame, pairs: DataFrame, now: Column) -> SyncPlan:
    """Plan one pass for every pair at once.

    ``pairs`` is (db_key, target, copier). The frames of ``dest`` and
    ``dest_listing`` carry ``target`` too. Pairs with nothing to do are dropped
    before any object row is read. The small tables every step starts from, and
    the copy list, are written to the shared folder once.
    """
    states = settle(pair_states(source.manifests, dest.manifests, pairs), "sync-states")
    pending = states.filter(F.col("state").isNull())
    roots = pending.select("db_key", F.col("head").alias("manifest_id")).distinct()
    members = settle(closure_members(source, roots, now), "sync-members")
    # A pinned manifest that is gone makes the whole closure unusable.
    broken = settle(members.filter(~F.col("present")).select("db_key").distinct(), "sync-broken")
    ready = pending.join(broken, "db_key", "left_anti")
    usable = members.join(broken, "db_key", "left_anti")

    present = settle(present_manifests(source, dest, ready, usable, now), "sync-present")
    candidates = settle(unproven_objects(source, dest, ready, usable, present), "sync-candidates")
    copies = settle(
        missing_at_target(candidates, dest_listing).select(*PAIR, "kind", "object_name"), "sync-copies"
    )
    to_commit = (
        usable.select("db_key", F.col("member_id").alias("manifest_id"))
        .join(ready.select(*PAIR), "db_key").select(*PAIR, "manifest_id")
        .join(present, [*PAIR, "manifest_id"], "left_anti")
    )
    with_work = copies.select(*PAIR).distinct().withColumn("_work", F.lit(True))
    restarts = broken.withColumn("_restart", F.lit(True))
    label = (
        F.when(F.col("state").isNotNull(), F.col("state"))
        .when(F.col("_restart"), F.lit("restart"))
        .when(F.col("_work"), F.lit("copy and commit"))
        .otherwise(F.lit("commit only"))
    )
    classified = (
        states.join(with_work, PAIR, "left").join(restarts, "db_key", "left")
        .select(
            *PAIR, label.alias("class"),
            (F.col("state").isNull() & F.col("watermark").isNull()).alias("seeding"),
            "head", "watermark", "next_wal_sst_id",
        )
    )
    return SyncPlan(classified, copies, commit_order(to_commit, PAIR))


def committed_rows(source: Catalog, commits: DataFrame, copies: DataFrame,
                   now: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The manifests, objects, checkpoints and listing rows that a target gains from a plan's copies and commits.

    A committed manifest keeps the time of its source; a copied object is as
    old as ``now``.
    """
    done = settle(commits.select(*PAIR, "manifest_id"), "committed")
    manifests, objects, checkpoints = (
        rows.join(done, ["db_key", "manifest_id"]) for rows in (source.manifests, source.objects, source.checkpoints)
    )
    parts = object_class(F.concat(F.lit("/"), F.col("object_name")))
    listed = copies.select(
        *PAIR, "kind", "object_name", F.when(F.col("kind") == "wal", parts["id"].cast("bigint")).alias("wal_id"),
        now.alias("last_modified"),
    )
    return manifests, objects, checkpoints, listed


def committed_state(source: Catalog, dest: Catalog, dest_listing: DataFrame, commits: DataFrame, copies: DataFrame,
                    now: Column) -> tuple[Catalog, DataFrame]:
    """The target and its listing once a plan's copies and commits are done; a committed manifest is readable."""
    manifests, objects, checkpoints, listed = committed_rows(source, commits, copies, now)
    if "readable" in dest.manifests.columns:
        manifests = manifests.withColumn("readable", F.lit(True))
    merged = Catalog(
        dest.manifests.unionByName(manifests, allowMissingColumns=True),
        dest.objects.unionByName(objects, allowMissingColumns=True),
        dest.checkpoints.unionByName(checkpoints, allowMissingColumns=True),
    )
    return merged, dest_listing.unionByName(listed, allowMissingColumns=True)


def tail_starts(manifests: DataFrame, listing: DataFrame) -> DataFrame:
    """(db_key, target, floor): the id from which on each target's log is tailed.

    That is the one after the target's last WAL, or where its newest manifest
    says that WALs which no snapshot holds begin, whichever is later.
    """
    last = listing.filter("kind = 'wal'").groupBy(*PAIR).agg((F.max("wal_id") + 1).alias("after"))
    tops = heads(manifests.select(*PAIR, "manifest_id", "next_wal_sst_id"), PAIR_KEYS)
    return tops.join(last, PAIR, "left").select(
        *PAIR, F.greatest("next_wal_sst_id", F.coalesce("after", F.lit(0))).cast("bigint").alias("floor")
    )


def sync_summary(plan: SyncPlan, prune_decisions: DataFrame | None = None,
                 source_listing: DataFrame | None = None) -> DataFrame:
    """One row per pair: head, committed or not, and what is copied and pruned.

    Bytes come from ``source_listing`` (db_key, kind, object_name, size); NULL
    without it.
    """
    commits = plan.commits.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("manifests_committed"))
    copied = plan.copies
    if source_listing is not None:
        sizes = source_listing.select("db_key", "kind", "object_name", "size")
        copied = copied.join(sizes, ["db_key", "kind", "object_name"], "left")
    else:
        copied = copied.withColumn("size", F.lit(None).cast("bigint"))
    copied = copied.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("objects_copied"), F.sum("size").alias("bytes_copied")
    )
    out = plan.pairs.join(commits, PAIR, "left").join(copied, PAIR, "left")
    pruned = ["pruned_manifests", "pruned_objects"]
    if prune_decisions is not None:
        gone = F.col("decision") == "delete"
        counts = prune_decisions.groupBy(*PAIR).agg(
            F.count_if(gone & (F.col("kind") == "manifest")).alias("pruned_manifests"),
            F.count_if(gone & (F.col("kind") != "manifest")).alias("pruned_objects"),
        )
        out = out.join(counts, PAIR, "left")
    else:
        out = out.select("*", *[F.lit(0).cast("bigint").alias(c) for c in pruned])
    zero = F.lit(0).cast("bigint")
    return out.select(
        *PAIR,
        "class",
        "head",
        F.col("class").isin("copy and commit", "commit only").alias("committed"),
        F.coalesce("manifests_committed", zero).alias("manifests_committed"),
        F.coalesce("objects_copied", zero).alias("objects_copied"),
        F.coalesce("bytes_copied", zero).alias("bytes_copied"),
        *[F.coalesce(F.col(c), zero).alias(c) for c in pruned],
    )
