"""Compaction job tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def queue_depth(databases: DataFrame, jobs: DataFrame) -> DataFrame:
    """(db_key, claimable, running) per database, zero where it has no jobs."""
    depth = jobs.groupBy("db_key").agg(
        F.count_if(F.col("status").isin("Submitted", "Scheduled")).alias("claimable"),
        F.count_if(F.col("status") == "Running").alias("running"),
    )
    zero = F.lit(0).cast("bigint")
    return databases.select("db_key").join(depth, "db_key", "left").select(
        "db_key",
        F.coalesce("claimable", zero).alias("claimable"),
        F.coalesce("running", zero).alias("running"),
    )
