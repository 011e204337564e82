"""Bodies of heartbeat and settings objects, read only where they are needed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BODY_TYPE = (
    "version int, node_id string, services array<struct<service:string,running:bigint,backoff:bigint>>"
)


def fetch_bodies(locations: DataFrame, tasks: int | None = None) -> DataFrame:
    """(location, body): the text of each object named in ``locations``, NULL if it is gone or no text.

    Only these objects are opened, so hand in the youngest of each node
    (:func:`quayside.operators.liveness.youngest_per_node`) or what changed
    (:func:`documents_to_read`). They are dealt over ``tasks``, by default as many
    as the session shuffles to.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for location in batch["location"]:
                try:
                    store, path = fs.FileSystem.from_uri(location)
                    with store.open_input_stream(path) as reader:
                        body = reader.read().decode()
                except (OSError, UnicodeDecodeError):
                    body = None
                yield pd.DataFrame({"location": [location], "body": pd.Series([body], dtype="object")})

    tasks = tasks or int(locations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return locations.select("location").distinct().repartition(tasks, "location").mapInPandas(run, "location string, body string")


def with_heartbeat_bodies(youngest: DataFrame, bodies: DataFrame, version_fields: tuple[str, ...]) -> DataFrame:
    """Add fields of each node's youngest heartbeat body; NULL where unreadable.

    ``bodies`` is (location, body). ``version_fields`` names the text fields to
    take. Unknown fields are ignored and a garbled body keeps its node's row.
    Joining on the youngest location reads one body per node.
    """
    schema = BODY_TYPE + "".join(f", `{name}` string" for name in version_fields)
    joined = youngest.join(bodies.select("location", "body"), "location", "left")
    parsed = joined.withColumn("_b", F.from_json("body", schema))
    # A body without its required fields is as unreadable as one that is no JSON.
    whole = F.col("_b.version").isNotNull() & F.col("_b.node_id").isNotNull()
    return parsed.select(
        *youngest.columns,
        F.when(whole, F.col("_b.version")).alias("body_version"),
        *[F.when(whole, F.col(f"_b.{name}")).alias(name) for name in version_fields],
        F.when(whole, F.col("_b.services")).alias("task_counts"),
    )


def documents_to_read(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Listing rows whose body must be fetched.

    Empty files carry no settings and files whose etag is already known did
    not change; neither is fetched. ``known`` is (path, etag).
    """
    changed = listing.filter(F.col("size") > 0)
    seen = known.filter(F.col("etag").isNotNull()).select("path", "etag")
    return changed.join(seen, ["path", "etag"], "left_anti")
