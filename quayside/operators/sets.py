"""Set algebra over object rows. Sets are rows, so duplicates collapse first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Rows of both sides that one task sorts or groups, about.
TASK_ROWS = 500_000


def _parts(*sides: DataFrame) -> int:
    """Into how many parts rows are dealt, so that each holds about :data:`TASK_ROWS` whatever the session shuffles to.

    Object names pack so well that partitions of a fair size on disk are many
    times that in memory, so rows are counted instead of bytes.
    """
    return max(1, -(-sum(side.count() for side in sides) // TASK_ROWS))


def difference(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Distinct ``on`` rows of ``left`` that are not in ``right``. Both are counted first: hand in written tables."""
    left, right = left.select(*on), right.select(*on)
    parts = _parts(left, right)
    return left.repartition(parts, *on).distinct().join(right.repartition(parts, *on), on, "left_anti")


def union(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Distinct ``on`` rows of both. Both are counted first: hand in written tables."""
    both = left.select(*on).unionByName(right.select(*on))
    return both.repartition(_parts(both), *on).distinct()


def looked_up(big: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """The distinct ``on`` rows of ``big`` that ``wanted`` asks for.

    An anti join of a few wanted rows with a large listing would shuffle the
    whole listing. Looking the rows up first does not: where ``wanted`` is small
    by its known size it is broadcast, and the listing is only filtered.
    """
    return big.select(*on).join(wanted.select(*on), on, "left_semi").distinct()


def with_self(live: DataFrame, viewers: DataFrame) -> DataFrame:
    """The node set each viewer places with: the live nodes, and itself.

    Returns only the rows a viewer adds (``viewer, node_id, services``): a
    viewer that is live adds nothing, since the shared live set has it.
    """
    return viewers.join(live.select("node_id"), "node_id", "left_anti").select(
        F.col("node_id").alias("viewer"), "node_id", "services"
    )
