"""Pins as leases: how long each stretch of refreshes kept a pin alive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.streaming.liveness import LATENESS


def lease_periods(refreshes: DataFrame, lifetime_seconds: int, lateness: str = LATENESS) -> DataFrame:
    """(pin_id, held_from, lapses_at, refreshes) per unbroken stretch.

    ``refreshes`` is a stream (or table) of (pin_id, ts): its creation and every
    refresh. A pin lives ``lifetime_seconds`` from the last of them. A refresh
    at the very moment of lapse comes too late and starts a new stretch.
    """
    gap = f"{lifetime_seconds - 1} seconds 999999 microseconds"
    held = (
        refreshes.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy("pin_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("refreshes"))
    )
    return held.select(
        "pin_id", F.col("w.start").alias("held_from"),
        F.timestamp_micros(F.unix_micros("w.end") + 1).alias("lapses_at"), "refreshes",
    )


def lapsed_passes(passes: DataFrame, periods: DataFrame) -> DataFrame:
    """Passes (pin_id, started_at, ended_at) whose pin did not live to the end.

    Pass and period are matched on the pin and the period the pass started in.
    """
    covering = periods.join(passes, "pin_id").filter(
        (F.col("started_at") >= F.col("held_from")) & (F.col("ended_at") < F.col("lapses_at"))
    )
    return passes.join(
        covering.select("pin_id", "started_at", "ended_at").distinct(),
        ["pin_id", "started_at", "ended_at"], "left_anti",
    )
