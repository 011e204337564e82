"""Ordered work within a key that stays spread out when one key is huge.

A window over ``partitionBy(key)`` puts a whole key into one task. Here each
key is cut into ranges of the ordering number, or into pieces of equal size,
these are summarised (a small table), and what one needs from its neighbours is
added to it as one extra row. The window then runs per (key, range).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.session import settle

# Numbers per range; a range is the unit of work of one window group.
RANGE_WIDTH = 65_536


def _range_of(column: str, width: int):
    return F.floor(F.col(column) / F.lit(width)).cast("bigint")


def row_number_by(df: DataFrame, keys: list[str], order: str, out: str, width: int = RANGE_WIDTH) -> DataFrame:
    """Add ``out``: the 1-based position of each row within its key.

    ``order`` is a BIGINT that is unique within the key.
    """
    ranged = df.withColumn("_range", _range_of(order, width))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_weight"))
    )
    rows = ranged.withColumn("_weight", F.lit(1).cast("bigint")).unionByName(
        offsets.withColumn("_offset", F.lit(True)), allowMissingColumns=True
    )
    running = (
        Window.partitionBy(*keys, "_range").orderBy(F.col("_offset").desc_nulls_last(), order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn(out, F.sum("_weight").over(running))
        .filter(F.col("_offset").isNull())
        .drop("_range", "_weight", "_offset")
    )


def pieces(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``df`` in the order of ``keys`` and ``order``, written, with the number ``_piece`` of the part each row lies in.

    Pieces hold about as many rows each, whether numbers are dense, sparse or
    skewed: they are the partitions of a range partitioning, for which Spark
    samples the rows. A busy key takes many pieces, many small keys share one,
    and equal rows of (keys, order) lie in the same. They are written so that
    every step that follows sees the same cuts.
    """
    dealt = df.repartitionByRange(*keys, order).withColumn("_piece", F.spark_partition_id())
    return settle(dealt, "pieces")


def next_id(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """Add ``out``: the next larger ``order`` of the key, NULL on the last row.

    Expects one row per (keys, order).
    """
    dealt = pieces(df, keys, order)
    following = Window.partitionBy(*keys).orderBy("_piece")
    first_of_next = (
        dealt.groupBy(*keys, "_piece").agg(F.min(order).alias("_first"))
        .select(*keys, "_piece", F.lead("_first").over(following).alias(order))
        .filter(F.col(order).isNotNull())
        .withColumn("_borrowed", F.lit(True))
    )
    rows = dealt.unionByName(first_of_next, allowMissingColumns=True)
    within = Window.partitionBy(*keys, "_piece").orderBy(order)
    return (
        rows.withColumn(out, F.lead(order).over(within))
        .filter(F.col("_borrowed").isNull())
        .drop("_piece", "_borrowed")
    )


def asof_round_down(
    points: DataFrame,
    samples: DataFrame,
    keys: list[str],
    point: str,
    sample: str,
    value: str,
    out: str,
    largest: bool = False,
) -> DataFrame:
    """Add ``out`` to ``points``: ``value`` of the newest sample at or below ``point``.

    With ``largest`` it is the largest ``value`` of all samples at or below
    ``point`` instead. NULL where every sample is larger. ``keys`` may be empty
    for one shared series of samples.

    Samples and points are cut into pieces together, so points that crowd
    between two samples, or lie beyond them all, are spread as well.
    """
    wanted = points.select(*keys, F.col(point).alias("_at")).filter(F.col(point).isNotNull()).distinct()
    known = samples.groupBy(*keys, F.col(sample).alias("_at")).agg(F.max(value).alias("_value")).filter(
        F.col("_at").isNotNull()
    )
    dealt = pieces(
        known.withColumn("_kind", F.lit(1)).unionByName(wanted.withColumn("_kind", F.lit(2)), allowMissingColumns=True),
        keys, "_at",
    )
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("_kind") == 1
    summary = F.max("_value") if largest else F.max_by("_value", F.when(own, F.col("_at")))

    def so_far(column: str):
        return F.max(column) if largest else F.last(column, ignorenulls=True)

    # The last sample of every piece, carried into the pieces after it.
    carried = (
        dealt.groupBy(*keys, "_piece").agg(summary.alias("_last"))
        .select(*keys, "_piece", so_far("_last").over(earlier).alias("_value"))
        .filter(F.col("_value").isNotNull())
        .withColumn("_kind", F.lit(0))
    )
    # A carried sample has no number and sorts before the piece's own ones.
    within = (
        Window.partitionBy(*keys, "_piece").orderBy(F.col("_at").asc_nulls_first(), "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answers = (
        dealt.unionByName(carried, allowMissingColumns=True).withColumn(out, so_far("_value").over(within))
        .filter(F.col("_kind") == 2)
        .select(*keys, F.col("_at").alias(point), out)
    )
    return points.join(answers, [*keys, point], "left")


def contiguous_from(ids: DataFrame, floors: DataFrame, keys: list[str], number: str, floor: str) -> DataFrame:
    """``keys, floor, next``: the first missing number at or above each floor.

    Everything in ``[floor, next)`` is present. A number is compared with its
    successor through one aggregation on (keys, number), so no key is read as
    an ordered whole. The floors are written first, so that their size is known:
    a few are broadcast, and the ids are not dealt by key for them.
    """
    floors = settle(floors, "floors")
    above = ids.select(*keys, number).join(floors, keys).filter(F.col(number) >= F.col(floor))
    present = above.select(*keys, number, F.lit(1).alias("_has"), F.lit(0).alias("_wanted"))
    successors = above.select(
        *keys, (F.col(number) + 1).alias(number), F.lit(0).alias("_has"), F.lit(1).alias("_wanted")
    )
    starts = floors.select(
        *keys, F.col(floor).alias(number), F.lit(0).alias("_has"), F.lit(1).alias("_wanted")
    )
    first_missing = (
        present.unionByName(successors).unionByName(starts)
        .groupBy(*keys, number).agg(F.max("_has").alias("_has"), F.max("_wanted").alias("_wanted"))
        .filter("_has = 0 AND _wanted = 1")
        .groupBy(*keys).agg(F.min(number).alias("next"))
    )
    return floors.join(first_missing, keys)


def contiguous_run(ids: DataFrame, floors: DataFrame, keys: list[str], number: str, floor: str) -> DataFrame:
    """The ids of the dense run that starts at each key's floor."""
    # Written, as the floors are: the ids of a few busy keys are filtered where they are, not dealt by key.
    bounds = settle(contiguous_from(ids, floors, keys, number, floor), "tail-ends")
    return (
        ids.select(*keys, number).distinct().join(bounds, keys)
        .filter((F.col(number) >= F.col(floor)) & (F.col(number) < F.col("next")))
        .select(*keys, number)
    )


def gaps(ids: DataFrame, keys: list[str], number: str) -> DataFrame:
    """``keys, gap_start, gap_end``: every hole between two present ids, inclusive."""
    following = next_id(ids.select(*keys, number).distinct(), keys, number, "_next")
    return following.filter(F.col("_next") > F.col(number) + 1).select(
        *keys, (F.col(number) + 1).alias("gap_start"), (F.col("_next") - 1).alias("gap_end")
    )
