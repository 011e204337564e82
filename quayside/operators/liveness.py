"""Which nodes are live, from their heartbeat objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.names import SERVICE_LETTERS
from quayside.functions.predicates import is_live


def youngest_per_node(entries: DataFrame) -> DataFrame:
    """One heartbeat per node: the youngest, the first location on a tie.

    An aggregate rather than a window, so a node with very many heartbeat
    objects is reduced before the shuffle.
    """
    picked = entries.groupBy("node_id").agg(
        F.min(F.struct("age_micros", "location", "services", "last_modified")).alias("h")
    )
    return picked.select(
        "node_id", "h.services", "h.age_micros", "h.location", "h.last_modified"
    )


def live_nodes(entries: DataFrame, timeout_seconds: float) -> DataFrame:
    """The youngest heartbeats that are strictly younger than the timeout."""
    return youngest_per_node(entries).filter(is_live(F.col("age_micros"), timeout_seconds))


def task_summary(offered: DataFrame, tasks: DataFrame) -> DataFrame:
    """Running and waiting tasks per node and offered service, zero if none.

    ``offered`` is (node_id, service), ``tasks`` is (node_id, service, state).
    A service with tasks that is not offered is listed too.
    """
    counts = tasks.groupBy("node_id", "service").agg(
        F.count_if(F.col("state") == "running").alias("running"),
        F.count_if(F.col("state") == "backoff").alias("backoff"),
    )
    letter = F.create_map(*[F.lit(x) for pair in SERVICE_LETTERS.items() for x in pair])
    zero = F.lit(0).cast("bigint")
    return offered.distinct().join(counts, ["node_id", "service"], "full").select(
        "node_id",
        "service",
        letter[F.col("service")].alias("letter"),
        F.coalesce("running", zero).alias("running"),
        F.coalesce("backoff", zero).alias("backoff"),
    )


def stale_heartbeats(entries: DataFrame, current_names: DataFrame, timeout_seconds: float) -> DataFrame:
    """Heartbeat objects to delete, with the reason.

    ``current_names`` is (node_id, location): the name each running node writes
    today. Its older names go, and so does any object dead for ten timeouts.
    """
    own = current_names.select("node_id", F.col("location").alias("current"))
    long_dead = ~is_live(F.col("age_micros"), 10 * timeout_seconds)
    replaced = F.col("current").isNotNull() & (F.col("location") != F.col("current"))
    return (
        entries.join(own, "node_id", "left")
        .filter(replaced | long_dead)
        .select(
            "node_id",
            "location",
            F.when(replaced, F.lit("replaced")).otherwise(F.lit("long dead")).alias("reason"),
        )
    )


def offers(nodes: DataFrame) -> DataFrame:
    """(service, node_id) rows of nodes that carry a ``services`` array."""
    return nodes.select(F.explode(F.array_distinct("services")).alias("service"), "node_id")


def candidate_counts(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add to each (database, service) key how many live nodes offer the service."""
    per_service = offers(nodes).groupBy("service").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.min("node_id").alias("first_candidate")
    )
    # Broadcast: one row per known service, and names only parse to known ones.
    return keys.join(F.broadcast(per_service), "service", "left").withColumn(
        "n_candidates", F.coalesce("n_candidates", F.lit(0).cast("bigint"))
    )


def seconds_of(micros: Column) -> Column:
    return F.floor(micros / F.lit(1_000_000)).cast("bigint")
