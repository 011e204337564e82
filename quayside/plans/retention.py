"""Retention: which restore points and objects of a target may be deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.names import manifest_name
from quayside.functions.predicates import micros_between
from quayside.operators.snapshot import Catalog, heads, live_pins
from quayside.session import settle

PAIR = ["db_key", "target"]
PAIR_KEYS = ("db_key", "target")


def pin_floor(checkpoints: DataFrame, policy: DataFrame, name_prefix: str) -> DataFrame:
    """(db_key, target, floor): the oldest pin of each target, less ``min_age``.

    A checkpoint belongs to a target if its name is ``name_prefix + target``.
    """
    named = checkpoints.withColumn("_for", F.col("name")).select("db_key", "_for", "create_time")
    wanted = policy.select(*PAIR, "min_age_s", F.concat(F.lit(name_prefix), "target").alias("_for"))
    return (
        named.join(wanted, ["db_key", "_for"])
        .groupBy(*PAIR)
        .agg(
            F.min(
                F.unix_micros(F.col("create_time").cast("timestamp"))
                - (F.col("min_age_s") * 1_000_000).cast("bigint")
            ).alias("floor")
        )
    )


def spared_objects(source: Catalog) -> DataFrame:
    """(db_key, kind, object_name) of each source's latest closure.

    Unlike a sync closure this counts expired checkpoints too, and a pinned
    manifest that is already gone is skipped.
    """
    roots = heads(source.manifests).select("db_key", "manifest_id")
    pins = source.checkpoints.join(roots, ["db_key", "manifest_id"], "left_semi").select(
        "db_key", F.col("pinned_id").alias("manifest_id")
    )
    members = settle(roots.unionByName(pins).distinct(), "prune-spared")
    return (
        source.objects.join(members, ["db_key", "manifest_id"], "left_semi")
        .select("db_key", "kind", "object_name").distinct()
    )


def kept_manifests(dest: Catalog, policy: DataFrame, now: Column) -> DataFrame:
    """(db_key, target, manifest_id, readable): restore points and their support.

    Restore points are the latest manifest and those younger than ``keep_s``.
    Support is what their live checkpoints pin, where the target has it.
    """
    latest = dest.manifests.groupBy(*PAIR).agg(F.max("manifest_id").alias("latest"))
    young = micros_between(now, F.col("last_modified")) < (F.col("keep_s") * 1_000_000).cast("bigint")
    with_policy = dest.manifests.join(policy.select(*PAIR, "keep_s"), PAIR).join(latest, PAIR)
    points = with_policy.filter((F.col("manifest_id") == F.col("latest")) | young).select(
        *PAIR, "manifest_id", "readable"
    )
    pinned = (
        live_pins(dest.checkpoints, points.filter("readable"), now, PAIR_KEYS)
        .select(*PAIR, F.col("pinned_id").alias("manifest_id")).distinct()
    )
    support = dest.manifests.join(pinned, [*PAIR, "manifest_id"], "left_semi").select(
        *PAIR, "manifest_id", "readable"
    )
    return points.unionByName(support).distinct()


def prune_plan(source: Catalog, dest: Catalog, dest_listing: DataFrame, policy: DataFrame, now: Column,
               pin_prefix: str = "mirror:", only_deletes: bool = False) -> DataFrame:
    """A decision and its reason for every manifest and data object of a target.

    With ``only_deletes`` all that is deleted, and not all that is kept: objects that their
    age or a guard keeps are then not looked up among those that are referenced.

    ``policy`` is (db_key, target, keep_s, min_age_s); a NULL ``keep_s`` leaves
    the pair out. ``dest.manifests`` has ``readable``; ``dest_listing`` is
    (db_key, target, kind, object_name, wal_id, last_modified). Data objects
    are kept wholesale where the source has no manifest to compare with, or a
    kept manifest is unreadable.

    Returns (db_key, target, kind, object_name, decision, reason).
    """
    active = policy.filter(F.col("keep_s").isNotNull())
    kept = settle(kept_manifests(dest, active, now), "prune-kept")
    out = [*PAIR, "kind", "object_name", "decision", "reason"]

    kept_flag = kept.select(*PAIR, "manifest_id", F.lit(True).alias("_kept"))
    is_kept = F.coalesce("_kept", F.lit(False))
    manifests = (
        dest.manifests.join(active.select(*PAIR), PAIR, "left_semi")
        .join(kept_flag, [*PAIR, "manifest_id"], "left")
        .select(
            *PAIR,
            F.lit("manifest").alias("kind"),
            manifest_name(F.col("manifest_id")).alias("object_name"),
            F.when(is_kept, F.lit("keep")).otherwise(F.lit("delete")).alias("decision"),
            F.when(is_kept, F.lit("restore point or support")).otherwise(F.lit("expired")).alias("reason"),
        )
    )

    # One row per pair: whether data may go at all, and the guards' bounds.
    # Written, so the listing is not shuffled where they are few, and a huge
    # pair can be split where they are not.
    tops = heads(dest.manifests, PAIR_KEYS).select(
        *PAIR, F.when(F.col("readable"), F.col("next_wal_sst_id")).otherwise(0).alias("tail_floor")
    )
    unreadable = kept.filter(~F.col("readable")).select(*PAIR).distinct().withColumn("_unreadable", F.lit(True))
    reachable = source.manifests.select("db_key").distinct().withColumn("_reachable", F.lit(True))
    # Every checkpoint a source still lists sits in its latest manifest.
    source_heads = heads(source.manifests).select("db_key", "manifest_id")
    listed = source.checkpoints.join(source_heads, ["db_key", "manifest_id"], "left_semi")
    guards = settle(
        active.join(tops, PAIR)
        .join(unreadable, PAIR, "left")
        .join(reachable, "db_key", "left")
        .join(pin_floor(listed, active, pin_prefix), PAIR, "left")
        .select(
            *PAIR, "min_age_s", "tail_floor", "floor",
            F.when(F.col("_reachable").isNull(), F.lit("source unreachable"))
            .when(F.col("_unreadable"), F.lit("a kept manifest is unreadable"))
            .alias("held"),
        ),
        "prune-guards",
    )
    referenced = (
        dest.objects.join(kept.select(*PAIR, "manifest_id"), [*PAIR, "manifest_id"], "left_semi")
        .select(*PAIR, "kind", "object_name").distinct().withColumn("_referenced", F.lit(True))
    )
    spared = spared_objects(source).withColumn("_spared", F.lit(True))
    modified = F.unix_micros(F.col("last_modified").cast("timestamp"))
    too_young = F.unix_micros(now.cast("timestamp")) - modified <= (F.col("min_age_s") * 1_000_000).cast("bigint")
    tail = (F.col("kind") == "wal") & (F.col("wal_id") >= F.col("tail_floor"))
    pinned = modified >= F.col("floor")
    reason = (
        F.when(F.col("held").isNotNull(), F.col("held"))
        .when(tail, F.lit("WAL tail"))
        .when(F.col("_referenced"), F.lit("referenced by a kept manifest"))
        .when(F.col("_spared"), F.lit("in the source's closure"))
        .when(too_young, F.lit("too young"))
        .when(pinned, F.lit("newer than the oldest pin"))
    )
    listing = dest_listing.join(guards, PAIR)
    if only_deletes:
        manifests = manifests.filter("decision = 'delete'")
        for kept_by_itself in (F.col("held").isNotNull(), tail, too_young, pinned):
            listing = listing.filter(~F.coalesce(kept_by_itself, F.lit(False)))
    data = (
        listing
        .join(referenced, [*PAIR, "kind", "object_name"], "left")
        .join(spared, ["db_key", "kind", "object_name"], "left")
        .withColumn("_reason", reason)
        .select(
            *PAIR, "kind", "object_name",
            F.when(F.col("_reason").isNull(), F.lit("delete")).otherwise(F.lit("keep")).alias("decision"),
            F.coalesce("_reason", F.lit("unreferenced")).alias("reason"),
        )
    )
    return manifests.select(*out).unionByName(data.select(*out))


def delete_order(decisions: DataFrame) -> DataFrame:
    """The objects to delete; ``phase`` 1 (manifests) must finish before phase 2."""
    return decisions.filter(F.col("decision") == "delete").select(
        *PAIR, "kind", "object_name",
        F.when(F.col("kind") == "manifest", F.lit(1)).otherwise(F.lit(2)).cast("bigint").alias("phase"),
    )
