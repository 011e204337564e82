"""Tailing a log of dense ids: in order, without holes, each id once.

What is handed on are runs of ids, one row however long, and what is kept are
runs, too. Ids of a log are first put together per range of ids, so a very busy
log is spread over as many keys as it has ranges; of each only the runs that a
front can enter meet at the log's front, at most two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quayside.operators.ordered import RANGE_WIDTH

KEYS = ["db_key", "target"]
_RUNS = "db_key bigint, target string, from_id bigint, to_id bigint"
_RUN_NAMES = ["db_key", "target", "from_id", "to_id"]


class _RangeRuns(StatefulProcessor):
    """Puts the ids of one range together and tells how far they are dense.

    A front enters a range at its start or at a floor in it, and a higher floor
    replaces a lower one. So only two runs of a range can ever be tailed: that from
    its start and that from its highest floor. Whatever holes a range has, it hands
    on these two when they grow, and keeps its ids as one packed value.
    """

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("range", "ids binary, floor int, told_start int, told_floor int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        db_key, target, number = key
        begin = number * self.width
        packed, floor, *told = self.state.get() if self.state.exists() else (b"", -1, 0, 0)
        # No ids stand for all of them.
        have = np.ones(self.width, dtype=bool)
        if packed is not None:
            have[:] = False
            if packed:
                have = np.unpackbits(np.frombuffer(zlib.decompress(packed), dtype=np.uint8), count=self.width).astype(bool)
        for frame in rows:
            places = frame["at"].to_numpy(dtype=np.int64) - begin
            is_floor = frame["is_floor"].to_numpy(dtype=bool)
            have[places[~is_floor]] = True
            highest = int(places[is_floor].max(initial=-1))
            if highest > floor:
                floor, told[1] = highest, 0
        full, grown = bool(have.all()), []
        for place, first in enumerate((0, floor)):
            if first < 0 or not have[first]:
                continue
            missing = int(np.argmin(have[first:]))
            end = first + missing if not have[first + missing] else self.width
            if end > told[place]:
                told[place] = end
                grown.append((db_key, target, begin + first, begin + end - 1))
        ids = None if full else zlib.compress(np.packbits(have).tobytes(), 1)
        self.state.update((ids, floor, *told))
        if grown:
            yield pd.DataFrame(grown, columns=_RUN_NAMES)

    def close(self) -> None:
        pass


class _Front(StatefulProcessor):
    """The next id of one log, and the runs beyond it that wait for a hole to be filled."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "next bigint")
        self.waiting = handle.getMapState("waiting", "first bigint", "last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.next.get()[0] if self.next.exists() else None
        front = before
        known = {first: last for (first,), (last,) in self.waiting.iterator()}
        waiting = dict(known)
        for frame in rows:
            floors = frame["floor"].dropna()
            if len(floors):
                front = max(int(floors.max()), int(floors.max()) if front is None else front)
            for first, last in frame.loc[frame["floor"].isna(), ["from_id", "to_id"]].itertuples(index=False):
                waiting[int(first)] = max(int(last), waiting.get(int(first), int(last)))
        start = front
        if front is not None:
            for first in sorted(waiting):
                if first > front:
                    break
                front = max(front, waiting.pop(first) + 1)
        for first in known.keys() - waiting.keys():
            self.waiting.removeKey((first,))
        for first, last in waiting.items():
            if known.get(first) != last:
                self.waiting.updateValue((first,), (last,))
        if front != before:
            self.next.update((front,))
        if front is not None and front > start:
            yield pd.DataFrame([(*key, start, front - 1)], columns=_RUN_NAMES)

    def close(self) -> None:
        pass


def tailed_runs(ids: DataFrame, floors: DataFrame, width: int = RANGE_WIDTH) -> DataFrame:
    """The next dense ids of every log, as runs (db_key, target, from_id, to_id).

    ``ids`` is a stream of (db_key, target, wal_id) in any order, ``floors`` one
    of (db_key, target, floor). A log's tail begins at its floor; a higher floor
    that comes later skips the ids a commit has covered. Ids that arrive early
    wait until the hole before them is filled, those below the front are
    dropped. Nothing that waits ever expires: that would be a hole.
    """
    none = F.lit(None).cast("bigint")
    wanted = floors.select(*KEYS, F.col("floor").cast("bigint").alias("floor")).filter("floor IS NOT NULL")

    def in_ranges(rows: DataFrame, at: str, is_floor: bool) -> DataFrame:
        number = F.expr(f"({at} - pmod({at}, {width})) div {width}")
        return rows.filter(F.col(at).isNotNull()).select(*KEYS, number.alias("_range"), F.col(at).cast("bigint").alias("at"), F.lit(is_floor).alias("is_floor"))

    ranged = in_ranges(ids, "wal_id", False).unionByName(in_ranges(wanted, "floor", True))
    runs = ranged.groupBy(*KEYS, "_range").transformWithStateInPandas(_RangeRuns(width), _RUNS, "Append", "None")
    both = runs.withColumn("floor", none).unionByName(
        wanted.select(*KEYS, none.alias("from_id"), none.alias("to_id"), "floor")
    )
    return both.groupBy(*KEYS).transformWithStateInPandas(_Front(), _RUNS, "Append", "None")


def ids_of(runs: DataFrame) -> DataFrame:
    """The single ids of runs, for those who want them."""
    return runs.select(*KEYS, F.explode(F.sequence("from_id", "to_id")).alias("wal_id"))
