"""Mixing sources to target weights by pivotal rounding of fractional copy numbers.

Every source has a target in words; its documents are all expected
``target / size of the source`` times. The whole part of that number is taken
as it is. The fractional part is rounded by the pivotal method: two documents
meet, mass moves from one to the other at random until one of them is
rounded, and the other goes on to meet the next. Mass is moved in words, not
in documents, so what a source gives stays within one document of its target,
and each document keeps its expected number of copies.

The rounding runs as a reduction tree. Leaves of bounded size are rounded
independently, each leaving one document undecided; these meet at the next
level in groups of ``FAN_IN``, until a source has one left, which is rounded
by a last draw. A document is decided once, at one level, so the results of
the levels are put together without looking back. However large a source is,
it is spread over its leaves.

Random numbers are hashes of a seed and the document, so reruns agree.

Defined results: rows with the same source and id are one unit and are taken
equally often. A null id or source is a value like any other. Texts without
words have size 0 and are taken 0 times, as is everything in a source without words.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import beside, WORD, ready, whole_text
from quayside.session import settle

# Units per leaf, and residuals that meet in a group above the leaves.
LEAF_UNITS = 2_048
FAN_IN = 512
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: str) -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("bigint")


def source_targets(
    sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, source_col: str = "source",
    size_col: str = "size",
) -> DataFrame:
    """Per source: ``source_size``, ``units`` and ``target``.

    Sources in order of their code points, null last, take the weights in
    turn. Targets share ``share`` times all words by weight, none above
    ``most`` times its source. With r = cap / weight, the capped sources are
    those with the smallest r; so the level of the others follows from
    running sums over the sources sorted by r. There is one row per source.
    """
    sources = sizes.groupBy(F.col(source_col).alias("source")).agg(
        F.sum(size_col).alias("source_size"), F.count(F.lit(1)).alias("units")
    )
    # Spark compares strings by their UTF-8 bytes, which is the order of code points.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    capped = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    open_weight = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = capped.withColumn("level", left / open_weight)
    # The first source in this order whose cap is not reached sets the level of all after it.
    reached = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)
    return levels.withColumn("first_open", reached["level"]).select(
        "source", "source_size", "units",
        F.least("cap", F.coalesce(F.col("first_open") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def round_group(units: pd.DataFrame, last: bool) -> pd.DataFrame:
    """Pivotal rounding of one group: all rows decided but one, or all if it is the ``last``.

    ``p`` is the fractional part and ``size`` the words that a copy brings.
    Large documents meet first, so that what is left over is small.
    """
    units = units.sort_values(["size", "draw", "unit"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    chance, size, draws = units["p"].tolist(), units["size"].tolist(), units["u"].tolist()
    held = -1
    for row in range(len(chance)):
        if not 0.0 < chance[row] < 1.0:
            continue
        if held < 0:
            held = row
            continue
        a, b, wa, wb = chance[held], chance[row], size[held], size[row]
        # Mass in words that can move from the new to the held one, and the other way.
        inward, outward = min((1 - a) * wa, b * wb), min(a * wa, (1 - b) * wb)
        # The draw that makes both moves fair, so that expected copies do not change.
        moved = inward if draws[row] * (inward + outward) < outward else -outward
        a, b = _settled(a + moved / wa), _settled(b - moved / wb)
        chance[held], chance[row] = a, b
        if not 0.0 < a < 1.0:
            held = row if 0.0 < b < 1.0 else -1
    if held >= 0 and last:
        # The low bits of a draw, which no comparison before has looked at.
        chance[held] = 1.0 if draws[held] * (1 << 26) % 1.0 < chance[held] else 0.0
    units["p"] = chance
    return units


def _settled(p: float) -> float:
    return 0.0 if p < 1e-12 else 1.0 if p > 1 - 1e-12 else p


def _uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that is the same in every run; another for every seed."""
    return F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def copy_numbers(sizes: DataFrame, targets: DataFrame, seed: int = 7, leaf_units: int = LEAF_UNITS, fan_in: int = FAN_IN) -> DataFrame:
    """Per unit (source, id): ``copies``, the times that its rows are taken.

    ``sizes`` has ``id``, ``source`` and ``size`` per unit.
    """
    ready(sizes.sparkSession)
    # One row per source; Spark broadcasts it by its true size or shuffles it.
    planned = sizes.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key = F.xxhash64(F.lit(seed), F.col("id").cast("string"), F.col("source"))
    groups = F.greatest(F.ceil(F.col("units") / leaf_units), F.lit(1)).cast("bigint")
    level = planned.select(
        "id", "source", F.col("size").cast("double").alias("size"),
        F.floor(expected).cast("bigint").alias("whole"), (expected - F.floor(expected)).alias("p"),
        F.col("id").cast("string").alias("unit"), key.alias("draw"),
        F.lit(0.0).alias("u"),
        F.pmod(key, groups).alias("leaf"), groups.alias("groups"),
    ).withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise(F.lit(0.0)))
    decided, depth = [], 0
    schema = level.schema
    most = targets.agg(F.max("units")).first()[0] or 0
    most = max(-(-most // leaf_units), 1)
    while True:
        last = most == 1

        def rounded(units: pd.DataFrame) -> pd.DataFrame:
            # A source with fewer leaves than the largest one is finished at a lower level.
            return round_group(units, bool(units["groups"].iloc[0] == 1))

        depth += 1
        level = level.withColumn("u", _uniform(seed + depth, "unit", "source"))
        done = settle(level.groupBy("source", "leaf").applyInPandas(rounded, schema), "rounded")
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        decided.append(done.filter(~is_open))
        if last:
            break
        most = -(-most // fan_in)
        fewer = F.ceil(F.col("groups") / fan_in).cast("bigint")
        level = done.filter(is_open).withColumn("leaf", F.pmod("leaf", fewer)).withColumn("groups", fewer)
    every = decided[0]
    for more in decided[1:]:
        every = every.unionByName(more)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("p").cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return every.select("id", "source", copies.alias("copies"))


def _planned(docs: DataFrame, share: float, most: float, seed: int, id_col: str, source_col: str, text_col: str):
    """Rows with their sizes, the targets of the sources, and the copies of the units."""
    sized = settle(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size")),
        "sizes",
    )
    units = sized.groupBy("id", "source").agg(F.sum("size").alias("size"))
    targets = settle(source_targets(units, share, most), "targets")
    return sized, targets, settle(copy_numbers(units, targets, seed), "copies")


def mix(
    docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id",
    source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """Per row: id, source, ``size`` in words, its source's size and target, and its ``copies``."""
    sized, targets, copies = _planned(docs, share, most, seed, id_col, source_col, text_col)
    return (
        _joined(_joined(sized, copies, ["id", "source"]), targets.drop("units"), ["source"])
        .withColumnsRenamed({"id": id_col, "source": source_col})
    )


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys match."""
    renamed = right.withColumnsRenamed({key: f"_{key}" for key in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(renamed[f"_{key}"])
    return left.join(renamed, condition).drop(*[f"_{key}" for key in keys])


def mixed_rows(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id",
               source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken. Other columns may have any names."""
    return beside(docs, [id_col, source_col, text_col], lambda rows: _mixed(rows, share, most, seed, id_col, source_col, text_col))


def _mixed(docs: DataFrame, share: float, most: float, seed: int, id_col: str, source_col: str, text_col: str) -> DataFrame:
    _, _, copies = _planned(docs, share, most, seed, id_col, source_col, text_col)
    times = copies.filter("copies > 0").select(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("copies").cast("int").alias("_copies"))
    joined = docs.join(
        times, docs[id_col].eqNullSafe(times["_id"]) & docs[source_col].cast("string").eqNullSafe(times["_source"])
    )
    return joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select(*docs.columns)
