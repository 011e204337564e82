"""Create-if-absent writes and ordered commits, as classified rows.

Both are safe to repeat: a second run finds its own rows and changes nothing.
They assume one writer per table, since Spark tables have no conditional put.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators.ordered import row_number_by
from quayside.session import settle


def create_if_absent(rows: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """Add ``created`` to each row: its key is new and it is the first to ask.

    The first asker per key is an aggregate, so a key requested very often is
    reduced before the shuffle. It is written before it is joined back, so that
    the join can split such a key.
    """
    first = rows.groupBy(key).agg(F.min(order).alias("_first"))
    fresh = settle(
        first.join(existing.select(key), key, "left_anti").withColumn("_fresh", F.lit(True)), "fresh-keys"
    )
    return rows.join(fresh, key, "left").withColumn(
        "created", F.coalesce(F.col("_fresh") & (F.col(order) == F.col("_first")), F.lit(False))
    ).drop("_first", "_fresh")


def commit_classes(source: DataFrame, target: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Classify members to commit by what the target has under their id.

    ``insert`` (absent), ``same`` (equal ``content``; success, not counted) or
    ``diverged`` (other content: somebody else wrote there). Members get a
    ``commit_seq``, ascending by id within the keys.
    """
    held = target.select(*keys, id_column, F.sha2("content", 256).alias("_held"))
    mine = source.select(*keys, id_column, F.sha2("content", 256).alias("_mine"))
    classed = mine.join(held, [*keys, id_column], "left").select(
        *keys,
        id_column,
        F.when(F.col("_held").isNull(), F.lit("insert"))
        .when(F.col("_held") == F.col("_mine"), F.lit("same"))
        .otherwise(F.lit("diverged")).alias("class"),
    )
    return row_number_by(classed, keys, id_column, "commit_seq")


def rows_to_insert(classes: DataFrame, keys: list[str]) -> DataFrame:
    """The inserts of groups without any divergence; one conflict stops its group."""
    bad = classes.filter(F.col("class") == "diverged").select(*keys).distinct()
    return classes.filter(F.col("class") == "insert").join(bad, keys, "left_anti")
