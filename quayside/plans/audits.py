"""Audits: is every copy complete, is every assignment owned, did formats drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.hashing import node_score
from quayside.functions.names import compacted_name, manifest_name, registry_name, wal_name
from quayside.operators.placement import rank_nodes, tally_nodes
from quayside.operators.sets import looked_up
from quayside.operators.snapshot import Catalog, heads, live_pins
from quayside.session import settle

PAIR = ["db_key", "target"]
PAIR_KEYS = ("db_key", "target")


def completeness_problems(source: Catalog, dest: Catalog, dest_listing: DataFrame, now: Column) -> DataFrame:
    """Every manifest or object a target's latest state needs and does not have.

    The state is the head and what its live checkpoints pin; a checkpoint the
    source has retired may dangle and is not followed.
    """
    tops = heads(dest.manifests, PAIR_KEYS).select(*PAIR, "manifest_id")
    source_heads = heads(source.manifests).select("db_key", "manifest_id")
    still_listed = (
        source.checkpoints.join(source_heads, ["db_key", "manifest_id"], "left_semi")
        .select("db_key", "cp_id").distinct()
    )
    pinned = (
        live_pins(dest.checkpoints, tops, now, PAIR_KEYS)
        .filter(F.col("pinned_id") != F.col("carrier"))
        .join(still_listed, ["db_key", "cp_id"], "left_semi")
        .select(*PAIR, F.col("pinned_id").alias("manifest_id")).distinct()
    )
    members = settle(tops.unionByName(pinned).distinct(), "audit-members")
    have = dest.manifests.select(*PAIR, "manifest_id")
    lost_manifests = members.join(have, [*PAIR, "manifest_id"], "left_anti").select(
        *PAIR, "manifest_id", manifest_name(F.col("manifest_id")).alias("object_name"),
        F.lit("pinned manifest missing").alias("problem"),
    )
    needed = dest.objects.join(members, [*PAIR, "manifest_id"], "left_semi")
    needed = settle(needed.select(*PAIR, "manifest_id", "kind", "object_name"), "audit-needed")
    on = [*PAIR, "kind", "object_name"]
    lost_objects = needed.join(looked_up(dest_listing, needed, on), on, "left_anti").select(
        *PAIR, "manifest_id", "object_name", F.lit("object missing").alias("problem")
    )
    return lost_manifests.unionByName(lost_objects)


def ownership_coverage(assignments: DataFrame, live: DataFrame, dead: DataFrame) -> DataFrame:
    """How many nodes believe they own each assignment.

    Every node places with the live set plus itself. A live node adds nothing,
    so the live owners are the claimants. A dead node claims an assignment if
    fewer than ``k`` live nodes score above it, which one comparison with the
    k-th live owner decides.

    Returns (db_url, service, target, k, live_claims, dead_claims).
    """
    owned = rank_nodes(assignments, live)
    last = F.element_at("owners", -1)
    # With a place left over there is no bar, and every dead node takes itself for an owner.
    full = (F.size("owners") >= F.col("k")) & (F.size("owners") > 0)
    barred = owned.select(
        "db_url", "service", "target", "k", F.size("owners").cast("bigint").alias("live_claims"),
        F.when(full, last["score"]).alias("bar_score"), F.when(full, last["node_id"]).alias("bar_node"),
    )
    return tally_nodes(barred, dead).select(
        "db_url", "service", "target", "k", "live_claims",
        F.when(F.col("k") > 0, F.col("n_ahead")).otherwise(F.lit(0).cast("bigint")).alias("dead_claims"),
    )


def golden_mismatches(names: DataFrame, scores: DataFrame) -> DataFrame:
    """Recompute recorded names and scores; return the rows that differ.

    ``names`` is (kind, source, want) with kind registry, manifest, wal or
    compacted; ``scores`` is (db_url, service, target, node_id, want).
    """
    # Unparsable numbers of other kinds never reach the padded names.
    number = F.col("source").try_cast("decimal(20,0)")
    got_name = (
        F.when(F.col("kind") == "registry", registry_name(F.col("source")))
        .when(F.col("kind") == "manifest", manifest_name(number))
        .when(F.col("kind") == "wal", wal_name(number))
        .when(F.col("kind") == "compacted", compacted_name(F.col("source")))
    )
    name_rows = names.select("kind", F.col("source").alias("subject"), "want", got_name.alias("got"))
    got_score = node_score(F.col("db_url"), F.col("service"), F.col("node_id"), F.col("target"))
    score_rows = scores.select(
        F.lit("score").alias("kind"),
        F.concat_ws(" ", "db_url", "service", "target", "node_id").alias("subject"),
        "want",
        got_score.alias("got"),
    )
    return name_rows.unionByName(score_rows).filter(~F.col("got").eqNullSafe(F.col("want")))
