"""Fleet status: nodes, who owns what, mirrors, and everything that looks wrong."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.predicates import is_live
from quayside.operators.liveness import live_nodes, offers, seconds_of, youngest_per_node
from quayside.operators.placement import rank_nodes
from quayside.operators.targets import (
    collision_messages, collisions, registered_destinations, unmirrored,
)


@dataclass(frozen=True)
class FleetStatus:
    nodes: DataFrame
    placements: DataFrame
    warnings: DataFrame


def node_status(entries: DataFrame, timeout_seconds: float) -> DataFrame:
    """Every node with a heartbeat object, dead or alive, age in whole seconds."""
    return youngest_per_node(entries).select(
        "node_id",
        is_live(F.col("age_micros"), timeout_seconds).alias("live"),
        seconds_of(F.col("age_micros")).alias("heartbeat_age_s"),
        "services",
        "location",
    )


def assignments(resolved: DataFrame, applied: DataFrame) -> DataFrame:
    """(db_url, service, target, k) that some node should own.

    ``resolved`` is (db_key, db_url, services, compaction_workers_count, ...).
    One owner each, except as many workers as the settings say. The mirror
    service is assigned per applied target. Both sides have a row per database:
    small as they are on disk, neither is to be broadcast.
    """
    wanted = resolved.select(
        "db_key", "db_url", "compaction_workers_count", F.explode("services").alias("service")
    )
    workers = F.col("service") == "compaction-workers"
    plain = wanted.filter(F.col("service") != "mirror").select(
        "db_url", "service", F.lit(None).cast("string").alias("target"),
        F.when(workers, F.col("compaction_workers_count")).otherwise(F.lit(1)).cast("bigint").alias("k"),
    )
    mirrors = wanted.filter(F.col("service") == "mirror").join(
        applied.select("db_key", "target").hint("merge"), "db_key"
    )
    return plain.unionByName(
        mirrors.select("db_url", "service", "target", F.lit(1).cast("bigint").alias("k"))
    )


def unoffered_services(wanted: DataFrame, live: DataFrame) -> DataFrame:
    """Services some assignment needs and no live node offers."""
    return wanted.filter(F.col("k") > 0).select("service").distinct().join(
        offers(live).select("service"), "service", "left_anti"
    )


def warnings(resolved: DataFrame, applied: DataFrame, wanted: DataFrame, live: DataFrame,
             databases: DataFrame, mirrors: bool = True, others: list[DataFrame] | None = None) -> DataFrame:
    """(kind, subject, message) of every warning, sorted by message.

    ``others`` are further (kind, subject, message) frames, such as registry or
    settings warnings. Mirror warnings are only made when asked for.
    """
    parts = list(others or [])

    def warn(df: DataFrame, kind: str, subject: Column, message: Column) -> None:
        parts.append(df.select(F.lit(kind).alias("kind"), subject.alias("subject"), message.alias("message")))

    subject = F.col("subject")
    if mirrors:
        mirroring = resolved.filter(F.array_contains("services", "mirror"))
        used = applied.join(mirroring.select("db_key").hint("merge"), "db_key", "left_semi")
        warn(collision_messages(collisions(used)), "collision", subject, F.col("message"))
        warn(
            unmirrored(mirroring.select("db_key", "db_url"), applied), "unmirrored", F.col("db_url"),
            F.concat("db_url", F.lit(" asks for a mirror, but none of the targets applies to it")),
        )
        warn(
            registered_destinations(used, databases), "registered destination", F.col("destination"),
            F.concat(
                F.lit("the mirror destination "), "destination", F.lit(" is registered as a database of its own"),
            ),
        )
    warn(
        unoffered_services(wanted, live), "unoffered", F.col("service"),
        F.concat(F.lit("nobody alive runs "), "service"),
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("message")


def fleet_status(entries: DataFrame, databases: DataFrame, resolved: DataFrame, applied: DataFrame,
                 timeout_seconds: float, mirrors: bool = True) -> FleetStatus:
    """All parts of the status report, each as its own lazy frame."""
    live = live_nodes(entries, timeout_seconds)
    wanted = assignments(resolved, applied)
    return FleetStatus(
        node_status(entries, timeout_seconds),
        rank_nodes(wanted, live),
        warnings(resolved, applied, wanted, live, databases, mirrors),
    )
