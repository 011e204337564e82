"""Periodic targets: which are due for their next cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.predicates import micros_between
from quayside.operators.ordered import asof_round_down
from quayside.operators.snapshot import heads
from quayside.session import settle

PAIR = ["db_key", "target"]


def due_cuts(pairs: DataFrame, dest: DataFrame, now: Column) -> DataFrame:
    """Add ``last_modified`` and ``due`` to (db_key, target, interval_s).

    A pair is due if its target has no manifest, or its latest one is at least
    the interval old. Nothing else is remembered between runs, so the job can
    be started by any schedule and repeated safely.
    """
    latest = heads(dest.select(*PAIR, "manifest_id", "last_modified"), ("db_key", "target"))
    age = micros_between(now, F.col("last_modified"))
    due = F.coalesce(age >= (F.col("interval_s") * 1_000_000).cast("bigint"), F.lit(True))
    return pairs.join(latest.select(*PAIR, "last_modified"), PAIR, "left").withColumn("due", due)


def cut_history(manifests: DataFrame, pairs: DataFrame) -> DataFrame:
    """(db_key, target, manifest_id, last_modified) of every cut that periodic targets have made of a history.

    ``manifests`` is (db_key, manifest_id, last_modified), ``pairs`` is
    (db_key, target, interval_s). The first manifest is cut; after a cut the
    first one at least the interval younger is the next. Of manifests of one
    moment the newest is taken, and an interval of nothing cuts every moment.

    Every moment is linked to the one that a cut there would be followed by,
    with lookups that read no history as a whole. The cuts are what the first
    moment leads to: each round doubles both the length of the links and the
    cuts found, so a history of n cuts takes about log n rounds.
    """
    moments = settle(
        manifests.groupBy("db_key", F.unix_micros(F.col("last_modified").cast("timestamp")).alias("at"))
        .agg(F.max("manifest_id").alias("manifest_id"), F.max("last_modified").alias("last_modified")).filter("at IS NOT NULL"),
        "cut-moments",
    )
    step = F.greatest((F.col("interval_s") * 1_000_000).cast("bigint"), F.lit(1))
    # Looking up the first moment at or after a time is looking down on the negative numbers.
    wanted = moments.join(pairs.select(*PAIR, "interval_s"), "db_key").select(*PAIR, "at", (-(F.col("at") + step)).alias("_point"))
    known = moments.join(pairs.select(*PAIR), "db_key").select(*PAIR, (-F.col("at")).alias("_sample"))
    followed = asof_round_down(wanted, known.withColumn("_value", F.col("_sample")), PAIR, "_point", "_sample", "_value", "_next")
    links = settle(followed.filter("_next IS NOT NULL").select(*PAIR, "at", (-F.col("_next")).alias("to")), "cut-links")
    cuts = settle(wanted.groupBy(*PAIR).agg(F.min("at").alias("at")), "cuts")
    while True:
        # Links now span as many cuts as have been found, so none is found twice.
        found = settle(cuts.join(links, [*PAIR, "at"]).select(*PAIR, F.col("to").alias("at")), "cuts")
        if found.isEmpty():
            break
        cuts = cuts.unionByName(found)
        onward = links.select(*PAIR, F.col("at").alias("to"), F.col("to").alias("_onward"))
        links = settle(links.join(onward, [*PAIR, "to"]).select(*PAIR, "at", F.col("_onward").alias("to")), "cut-links")
    return cuts.join(moments, ["db_key", "at"]).select(*PAIR, "manifest_id", "last_modified")
