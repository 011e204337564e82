"""Sets of whole numbers as runs, so that a window of a billion ids is one row.

A run is a row ``start, end`` of two BIGINT columns: the numbers from ``start``
up to, but without, ``end``. Runs of one key may overlap, repeat or be empty; rows
with a null bound are empty. All results are the fewest runs that say the same:
they do not overlap or touch.

The algebra is one sweep over the end points. Equal end points are added up
before they are shuffled, and the sweep works on :func:`~quayside.operators.ordered.pieces`
of equal size, so a key with very many runs is swept by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.operators.ordered import pieces
from quayside.session import settle

# Ids that one row is expanded to at once.
CHUNK = 4_096


def as_runs(ids: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Each id as a run of its own; nulls are left out."""
    at = F.col(number).cast("bigint")
    return ids.filter(at.isNotNull()).select(*keys, at.alias("start"), (at + 1).alias("end"))


def _end_points(runs: DataFrame, keys: list[str], side: str) -> DataFrame:
    """(keys, at, left, right): by how much either side's cover changes at a point."""
    both = F.array(
        F.struct(F.col("start").alias("at"), F.lit(1).alias("by")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("by"))
    )
    points = runs.filter("end > start").select(*keys, F.explode(both).alias("_point"))
    change = {name: F.col("_point.by") if name == side else F.lit(0) for name in ("left", "right")}
    return points.select(*keys, F.col("_point.at").alias("_at"), *[c.cast("bigint").alias(f"_{name}") for name, c in change.items()])


def _sweep(points: DataFrame, keys: list[str], **wanted: Callable[[Column, Column], Column]) -> DataFrame:
    """(op, keys, start, end): the runs over which each of ``wanted`` holds for the cover of the two sides."""
    sides = ["_left", "_right"]
    changes = points.groupBy(*keys, "_at").agg(*[F.sum(s).alias(s) for s in sides]).filter("_left <> 0 OR _right <> 0")
    dealt = pieces(changes, keys, "_at")
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # What earlier pieces add up to comes first in a piece, as a row without a point.
    carried = dealt.groupBy(*keys, "_piece").agg(*[F.sum(s).alias(s) for s in sides]).select(
        *keys, "_piece", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(s) for s in sides]
    )
    running = (
        Window.partitionBy(*keys, "_piece").orderBy(F.col("_at").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    left, right = (F.col(f"_after{s}") for s in sides)
    swept = dealt.unionByName(carried, allowMissingColumns=True).select(
        "*", *[F.sum(s).over(running).alias(f"_after{s}") for s in sides]
    )
    turn = F.array(*[
        F.struct(F.lit(op).alias("op"), holds(left, right).alias("opens"),
                 holds(left - F.col("_left"), right - F.col("_right")).alias("was"))
        for op, holds in wanted.items()
    ])
    turns = settle(
        swept.filter(F.col("_at").isNotNull())
        .select(*keys, "_piece", "_at", F.explode(turn).alias("_turn")).filter("_turn.opens <> _turn.was")
        .select(F.col("_turn.op").alias("op"), *keys, "_piece", "_at", F.col("_turn.opens").alias("_opens")),
        "turns",
    )
    # Openings and closings alternate, so a run ends at the next turn, which may lie in a later piece.
    first_of_next = (
        turns.groupBy("op", *keys, "_piece").agg(F.min("_at").alias("_first"))
        .select("op", *keys, "_piece", F.lead("_first").over(Window.partitionBy("op", *keys).orderBy("_piece")).alias("_at"))
        .filter(F.col("_at").isNotNull()).withColumn("_opens", F.lit(False))
    )
    following = F.lead("_at").over(Window.partitionBy("op", *keys, "_piece").orderBy("_at"))
    return (
        turns.unionByName(first_of_next).withColumn("_end", following)
        .filter(F.col("_opens") & F.col("_end").isNotNull())
        .select("op", *keys, F.col("_at").alias("start"), F.col("_end").alias("end"))
    )


def merged(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The runs of each key, put together where they overlap or touch."""
    return _sweep(_end_points(runs, keys, "left"), keys, merged=lambda left, _: left > 0).drop("op")


def holes(runs: DataFrame, keys: list[str]) -> DataFrame:
    """What lies between each key's runs and belongs to none."""
    return _sweep(_end_points(runs, keys, "left"), keys, holes=lambda left, _: left == 0).drop("op")


# What of two sides each operation keeps, by how often either covers a number.
_ALGEBRA: dict[str, Callable[[Column, Column], Column]] = {
    "union": lambda a, b: (a > 0) | (b > 0),
    "intersection": lambda a, b: (a > 0) & (b > 0),
    "difference": lambda a, b: (a > 0) & (b == 0),
}


def algebra(left: DataFrame, right: DataFrame, keys: list[str], ops: list[str]) -> DataFrame:
    """(op, keys, start, end) of several of ``union``, ``intersection`` and ``difference``, in one sweep for all."""
    both = _end_points(left, keys, "left").unionByName(_end_points(right, keys, "right"))
    return _sweep(both, keys, **{op: _ALGEBRA[op] for op in ops})


def union(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return algebra(left, right, keys, ["union"]).drop("op")


def intersection(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return algebra(left, right, keys, ["intersection"]).drop("op")


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """What is in ``left`` and not in ``right``."""
    return algebra(left, right, keys, ["difference"]).drop("op")


def dense_until(runs: DataFrame, floors: DataFrame, keys: list[str], floor: str) -> DataFrame:
    """Add ``next`` to ``floors``: everything in ``[floor, next)`` is in the runs, ``next`` is not.

    A floor that no run holds has itself as ``next``; a null floor has none.
    """
    asked = floors.select(*keys, floor).distinct()
    around = (
        merged(runs, keys).join(asked, keys)
        .filter((F.col("start") <= F.col(floor)) & (F.col(floor) < F.col("end")))
        .select(*keys, floor, F.col("end").alias("next"))
    )
    return floors.join(around, [*keys, floor], "left").withColumn("next", F.coalesce("next", floor))


def sizes(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_ids): how many numbers each key's runs hold, repeats counted once."""
    return merged(runs, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("n_ids"))


def chunks(start: Column, end: Column) -> Column:
    """The first numbers of the chunks of a run, an empty array for an empty run."""
    return F.when(end > start, F.sequence(start, end - 1, F.lit(CHUNK).cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )


def chunk_ids(first: Column, end: Column) -> Column:
    """The numbers of one chunk of a run."""
    return F.sequence(first, F.least(first + CHUNK, end) - 1)


def ids(runs: DataFrame, number: str) -> DataFrame:
    """The numbers of each run, a row per number in place of ``start`` and ``end``.

    Runs are cut into chunks, so no row holds more than :data:`CHUNK` numbers at once.
    """
    rest = [c for c in runs.columns if c not in ("start", "end")]
    cut = runs.select(*rest, "end", F.explode(chunks(F.col("start"), F.col("end"))).alias("_first"))
    return cut.select(*rest, F.explode(chunk_ids(F.col("_first"), F.col("end"))).alias(number))
