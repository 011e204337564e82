"""How far every mirror trails its source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.predicates import behind, micros_between
from quayside.operators.ordered import asof_round_down
from quayside.operators.snapshot import heads
from quayside.session import settle

PAIR = ["db_key", "target"]


def mirror_lag(pairs: DataFrame, source: DataFrame, dest: DataFrame, source_wals: DataFrame,
               dest_wals: DataFrame, samples: DataFrame, sample_keys: list[str] | None = None,
               failures: DataFrame | None = None) -> DataFrame:
    """Lag per (db_key, target) in manifests, WAL ids and seconds.

    Both sides' sequence numbers are mapped to time through the source's
    samples (sample_keys, seq, ts). ``failures`` (db_key, target, error) lists
    pairs that could not be read: they keep their row and carry the error.
    """
    sample_keys = ["db_key"] if sample_keys is None else sample_keys
    src = heads(source).select(
        "db_key", F.col("manifest_id").alias("source_manifest_id"), F.col("last_l0_seq").alias("source_seq")
    )
    dst = heads(dest, ("db_key", "target")).select(
        *PAIR, F.col("manifest_id").alias("dest_manifest_id"), F.col("last_l0_seq").alias("dest_seq")
    )
    src_wal = source_wals.groupBy("db_key").agg(F.max("wal_id").alias("source_wal"))
    dst_wal = dest_wals.groupBy(*PAIR).agg(F.max("wal_id").alias("dest_wal"))
    rows = (
        pairs.join(src, "db_key", "left").join(dst, PAIR, "left")
        .join(src_wal, "db_key", "left").join(dst_wal, PAIR, "left")
    )
    # Both sides' numbers are looked up at once.
    sides = ("source", "dest")
    asked = rows.select(*sample_keys, F.explode(F.array(*[f"{side}_seq" for side in sides])).alias("_seq")).distinct()
    times = settle(asof_round_down(asked.filter(F.col("_seq").isNotNull()), samples, sample_keys, "_seq", "seq", "ts", "_ts"), "lag-times")
    for side in sides:
        found = times.withColumnsRenamed({"_seq": f"{side}_seq", "_ts": f"{side}_ts"})
        rows = rows.join(found, [*sample_keys, f"{side}_seq"], "left")
    if failures is not None:
        rows = rows.join(failures.select(*PAIR, "error"), PAIR, "left")
    else:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    rows = rows.withColumn(
        "error",
        F.coalesce("error", F.when(F.col("source_manifest_id").isNull(), F.lit("source has no manifest"))),
    )
    ok, mirrored = F.col("error").isNull(), F.col("dest_manifest_id").isNotNull()
    seconds = F.floor(
        F.greatest(F.lit(0).cast("bigint"), micros_between(F.col("source_ts"), F.col("dest_ts")))
        / F.lit(1_000_000)
    ).cast("bigint")
    return rows.select(
        *PAIR,
        F.when(ok, F.col("source_manifest_id")).alias("source_manifest_id"),
        F.when(ok, F.col("dest_manifest_id")).alias("dest_manifest_id"),
        F.when(ok, behind(F.col("source_manifest_id"), F.col("dest_manifest_id"))).alias("manifests_behind"),
        F.when(ok & mirrored, behind(F.col("source_wal"), F.col("dest_wal"))).alias("wal_behind"),
        F.when(ok & mirrored, seconds).alias("seconds_behind"),
        "error",
    )
