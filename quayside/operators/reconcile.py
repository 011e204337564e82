"""Owned against running assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["db_url", "service", "target"]


def reconcile(owned: DataFrame, running: DataFrame) -> DataFrame:
    """(db_url, service, target, action) for every owned or running assignment.

    Both sides are (db_url, service, target, fingerprint). ``target`` is NULL
    for services without one, so keys compare null-safely. The action is
    start, stop, restart (the settings changed) or keep.
    """
    o, r = owned.alias("o"), running.alias("r")
    same = F.lit(True)
    for key in KEYS:
        same = same & F.col(f"o.{key}").eqNullSafe(F.col(f"r.{key}"))
    have = F.col("o.fingerprint").isNotNull()
    runs = F.col("r.fingerprint").isNotNull()
    action = (
        F.when(have & ~runs, F.lit("start")).when(runs & ~have, F.lit("stop"))
        .when(F.col("o.fingerprint") != F.col("r.fingerprint"), F.lit("restart")).otherwise(F.lit("keep"))
    )
    return o.join(r, same, "full").select(
        *[F.coalesce(F.col(f"o.{k}"), F.col(f"r.{k}")).alias(k) for k in KEYS], action.alias("action")
    )
