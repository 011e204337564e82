"""Liveness over a stream of heartbeats."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# How late a row may arrive and still be counted by a stream of periods.
LATENESS = "1 hour"


def liveness_periods(heartbeats: DataFrame, timeout_seconds: int, lateness: str = LATENESS) -> DataFrame:
    """(node_id, up_at, down_at, heartbeats, services) per uninterrupted period.

    ``heartbeats`` is a stream (or table) of (node_id, ts, services). A node
    is live while its last heartbeat is strictly younger than the timeout, so a
    period is a session whose gaps stay below it. In append mode a period comes
    out once the watermark has passed its end. Sessions merge partially before
    the shuffle, so one chatty node is no bottleneck. The newest name decides
    the services.
    """
    # Sessions also join across a gap of exactly their length: one microsecond
    # less makes the bound strict.
    gap = f"{timeout_seconds - 1} seconds 999999 microseconds"
    sessions = (
        heartbeats.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy("node_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("heartbeats"), F.max_by("services", "ts").alias("services"))
    )
    down = F.timestamp_micros(F.unix_micros("w.end") + 1)
    return sessions.select(
        "node_id", F.col("w.start").alias("up_at"), down.alias("down_at"), "heartbeats", "services"
    )


def to_the_end(emitted: DataFrame, rows: DataFrame, key: str, end: str, periods: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All periods up to now: what a stream has emitted, and what it still holds.

    ``rows`` are the stream's input as a table (``key``, ts, ...) and
    ``periods`` is the function that the stream applied. The periods after the
    last emitted one of a key are made from its later rows, also for a key all
    of whose rows came too late for the watermark. A period that has not ended
    at the newest row has a NULL ``end``.
    """
    done = emitted.groupBy(key).agg(F.max(end).alias("_done"))
    later = rows.join(done, key, "left").filter(F.col("_done").isNull() | (F.col("ts").cast("timestamp") >= F.col("_done")))
    newest = rows.agg(F.max(F.col("ts").cast("timestamp"))).scalar()
    held = periods(later.drop("_done"))
    return emitted.unionByName(held.withColumn(end, F.when(F.col(end) <= newest, F.col(end))))


# What the processor takes and gives: times in microseconds, services joined by commas.
_CHANGED = "node_id string, change string, at bigint, services string"


class _Transitions(StatefulProcessor):
    """Follows one node: its youngest heartbeat, whether it is live, and the timer that takes it down."""

    def __init__(self, timeout_micros: int):
        self.timeout = timeout_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.node = handle.getValueState("node", "at bigint, services string, live boolean")

    def _expiry(self, at: int) -> int:
        return -(-(at + self.timeout) // 1000)

    def _emitted(self, node_id: str, changes: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(node_id, *change) for change in changes], columns=["node_id", "change", "at", "services"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (node_id,) = key
        if not node_id:
            return  # A tick of the clock.
        seen = [tuple(row) for frame in rows for row in frame[["at", "deleted", "location", "services"]].itertuples(index=False)]
        known = self.node.get() if self.node.exists() else None
        at, services, live = known or (None, None, False)
        was_at, was_live = at, live
        changes = []
        for now, deleted, _, offered in sorted(seen, key=lambda row: row[:3]):
            now = int(now)
            # The youngest that earlier batches knew decides what is too late.
            if was_at is not None and now <= was_at:
                continue
            if live and now - at >= self.timeout:
                changes.append(("down", at + self.timeout, services))
                live = False
            if deleted:
                if live:
                    changes.append(("down", now, services))
                live = False
            else:
                if not live:
                    changes.append(("up", now, offered))
                elif offered != services:
                    changes.append(("role", now, offered))
                live, services = True, offered
            at = now
        if at != was_at:
            if was_live:
                self.handle.deleteTimer(self._expiry(was_at))
            if live:
                self.handle.registerTimer(self._expiry(at))
            self.node.update((at, services, live))
        if changes:
            yield self._emitted(node_id, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, services, live = self.node.get()
        if live and expiredTimerInfo.getExpiryTimeInMs() >= self._expiry(at):
            self.node.update((at, services, False))
            yield self._emitted(key[0], [("down", at + self.timeout, services)])

    def close(self) -> None:
        pass


def liveness_changes(heartbeats: DataFrame, timeout_seconds: float, lateness: str | None = None) -> DataFrame:
    """Up, down and role changes (node_id, change, at, services) as they happen.

    ``heartbeats`` is a stream of (node_id, services, last_modified, location,
    deleted). Each node keeps one row of state. A heartbeat that is not younger
    than the youngest known one is ignored; a ``deleted`` row is a clean exit and
    takes the node down at once. A node whose heartbeats stop is taken down by a
    timer, without any row of its own.

    Without ``lateness`` the timers follow the clock of the cluster, which is
    how a running fleet is watched; trigger it by processing time. With it they
    follow the newest time in the stream less that much, so that replaying a
    history always gives the same; rows with an empty node id then only move
    that time on (see :func:`clock_ticks`). Run it with
    :func:`quayside.streaming.keyed.start`.
    """
    rows = heartbeats.withColumn("last_modified", F.col("last_modified").cast("timestamp"))
    if lateness is not None:
        rows = rows.withWatermark("last_modified", lateness)
    seen = rows.select(
        "node_id", F.array_join("services", ",").alias("services"), F.unix_micros("last_modified").alias("at"),
        F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce("location", F.lit("")).alias("location"), "last_modified",
    ).filter(F.col("node_id").isNotNull() & F.col("at").isNotNull())
    changed = seen.groupBy("node_id").transformWithStateInPandas(
        _Transitions(round(timeout_seconds * 1_000_000)), _CHANGED, "Append", "ProcessingTime" if lateness is None else "EventTime"
    )
    return changed.select(
        "node_id", "change", F.timestamp_micros("at").alias("at"),
        F.when(F.col("services") == "", F.array().cast("array<string>")).otherwise(F.split("services", ",")).alias("services"),
    )


def clock_ticks(times: DataFrame) -> DataFrame:
    """Heartbeat rows of nobody, which move time on: from a stream with a ``timestamp``, such as the rate source."""
    return times.select(
        F.lit("").alias("node_id"), F.array().cast("array<string>").alias("services"), F.col("timestamp").alias("last_modified"),
        F.lit("").alias("location"), F.lit(False).alias("deleted"),
    )
