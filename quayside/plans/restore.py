"""Restoring a backup at its latest state, at a snapshot id, or at a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators.ordered import asof_round_down
from quayside.operators.snapshot import Catalog, closure_members, closure_objects
from quayside.plans.mirror import commit_order
from quayside.session import settle


@dataclass(frozen=True)
class RestorePlan:
    """``outcomes``  one row per request: manifest_id and counts, or an error
    ``copies``    (request_id, kind, object_name)
    ``commits``   (request_id, manifest_id, commit_seq), the restore point last
    """

    outcomes: DataFrame
    copies: DataFrame
    commits: DataFrame


def snapshot_times(manifests: DataFrame, samples: DataFrame, sample_keys: list[str]) -> DataFrame:
    """Add ``mapped_ts``: when each manifest's recorded state was written.

    ``samples`` is (sample_keys, seq, ts); rounding is down, and a state older
    than every sample maps to NULL.
    """
    return asof_round_down(manifests, samples, sample_keys, "last_l0_seq", "seq", "ts", "mapped_ts")


def resolve_points(backup: Catalog, requests: DataFrame, samples: DataFrame, sample_keys: list[str]) -> DataFrame:
    """Add ``latest`` and ``chosen`` to (request_id, db_key, mode, want_id, at).

    By time, the highest manifest id whose mapped time is at or before ``at``
    is chosen. That is a running maximum over time looked up per request, so
    requests are never paired with all manifests of their database.
    """
    ids = backup.manifests.select("db_key", "manifest_id")
    latest = ids.groupBy("db_key").agg(F.max("manifest_id").alias("latest"))
    timed = snapshot_times(backup.manifests.select("db_key", "manifest_id", "last_l0_seq"), samples, sample_keys)
    by_time = timed.filter(F.col("mapped_ts").isNotNull()).select(
        "db_key", F.unix_micros(F.col("mapped_ts").cast("timestamp")).alias("micros"), "manifest_id"
    )
    asked = requests.join(latest, "db_key", "left").withColumn(
        "_at", F.when(F.col("mode") == "time", F.unix_micros(F.col("at").cast("timestamp")))
    )
    dated = asof_round_down(asked, by_time, ["db_key"], "_at", "micros", "manifest_id", "_by_time", largest=True)
    exact = ids.select("db_key", F.col("manifest_id").alias("want_id"), F.lit(True).alias("_exists"))
    chosen = (
        F.when(F.col("mode") == "latest", F.col("latest"))
        .when((F.col("mode") == "id") & F.col("_exists"), F.col("want_id"))
        .when(F.col("mode") == "time", F.col("_by_time"))
    )
    return dated.join(exact, ["db_key", "want_id"], "left").withColumn("chosen", chosen).drop(
        "_at", "_by_time", "_exists"
    )


def restore_plan(backup: Catalog, requests: DataFrame, samples: DataFrame, occupied: DataFrame,
                 now: Column, sample_keys: list[str] | None = None) -> RestorePlan:
    """Plan every request: (request_id, db_key, dest, mode, want_id, at).

    ``occupied`` lists destinations that hold objects (column ``dest``); those
    are refused. The closure is read from the backup alone, and a restore point
    whose live checkpoint pins a manifest the backup lacks is refused.
    """
    sample_keys = ["db_key"] if sample_keys is None else sample_keys
    full = occupied.select("dest").distinct().withColumn("_full", F.lit(True))
    points = settle(
        resolve_points(backup, requests, samples, sample_keys).join(full, "dest", "left"), "restore-points"
    )
    open_points = points.filter(F.col("_full").isNull() & F.col("chosen").isNotNull())
    roots = open_points.select("db_key", F.col("chosen").alias("manifest_id")).distinct()
    members = settle(closure_members(backup, roots, now), "restore-members")
    dangling = members.filter(~F.col("present")).select("db_key", "head").distinct()
    usable = members.join(dangling, ["db_key", "head"], "left_anti")

    asked = open_points.select("request_id", "db_key", F.col("chosen").alias("head"))
    objects = closure_objects(usable, backup.objects)
    copies = objects.join(asked, ["db_key", "head"]).select("request_id", "kind", "object_name")
    commits = commit_order(
        usable.join(asked, ["db_key", "head"]).select("request_id", F.col("member_id").alias("manifest_id")),
        ["request_id"],
    )
    # Requests for the same restore point have the same counts, so they are counted once per point.
    n_objects = objects.groupBy("db_key", "head").agg(F.count(F.lit(1)).alias("copied_objects"))
    n_manifests = usable.groupBy("db_key", "head").agg(F.count(F.lit(1)).alias("manifests_committed"))
    counted = n_manifests.join(n_objects, ["db_key", "head"], "left").withColumnRenamed("head", "chosen")
    error = (
        F.when(F.col("_full"), F.lit("target holds data already"))
        .when(F.col("latest").isNull(), F.lit("no manifests at the source"))
        .when(F.col("chosen").isNull() & (F.col("mode") == "id"), F.lit("manifest unknown"))
        .when(F.col("chosen").isNull(), F.lit("earlier than the first recorded time"))
        .when(F.col("_dangling"), F.lit("kept for others only, cannot be restored"))
    )
    flagged = dangling.select("db_key", F.col("head").alias("chosen"), F.lit(True).alias("_dangling"))
    zero = F.lit(0).cast("bigint")
    outcomes = (
        points.join(flagged, ["db_key", "chosen"], "left")
        .join(counted, ["db_key", "chosen"], "left")
        .withColumn("error", error)
        .select(
            "request_id", "db_key", "mode",
            F.when(F.col("error").isNull(), F.col("chosen")).alias("manifest_id"),
            F.when(F.col("error").isNull(), F.coalesce("manifests_committed", zero)).otherwise(zero).alias("manifests_committed"),
            F.when(F.col("error").isNull(), F.coalesce("copied_objects", zero)).otherwise(zero).alias("copied_objects"),
            "error",
        )
    )
    return RestorePlan(outcomes, copies, commits)
