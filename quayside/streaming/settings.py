"""Last-good settings over a stream of document versions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quayside.operators.settings import last_good

_VERSIONS = "key string, version bigint, valid boolean, payload string"


def _decisive(versions: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per key the newest version and the newest valid one of each batch: no others can be in force."""
    for frame in versions:
        # Equal versions are told apart by their payload, in byte order.
        order = frame.assign(_payload=frame["payload"].map(lambda text: b"" if text is None else text.encode()))
        order = order.sort_values(["version", "_payload"], kind="stable")
        valid = order[order["valid"].fillna(False).astype(bool)].groupby("key").tail(1)
        yield pd.concat([order.groupby("key").tail(1), valid])[["key", "version", "valid", "payload"]].drop_duplicates()


class _LastGood(StatefulProcessor):
    """The newest and the newest valid version of one key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.versions = handle.getValueState("versions", "latest bigint, used bigint, payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.versions.get()) if self.versions.exists() else (None, None, None)
        latest, used, payload = before
        good = None if used is None else (used, b"" if payload is None else payload.encode(), payload)
        for frame in rows:
            for version, valid, text in frame[["version", "valid", "payload"]].itertuples(index=False):
                version = int(version)
                latest = version if latest is None else max(latest, version)
                if valid:
                    found = (version, b"" if text is None else text.encode(), text)
                    good = found if good is None or found[:2] > good[:2] else good
        after = (latest, *((None, None) if good is None else (good[0], good[2])))
        if after != before:
            self.versions.update(after)
            yield pd.DataFrame([(key[0], *after)], columns=["key", "latest", "used", "payload"]).astype({"used": "Int64"})

    def close(self) -> None:
        pass


def settings_changes(versions: DataFrame) -> DataFrame:
    """(key, latest, used, payload) whenever the versions in force of a key change.

    ``versions`` is a stream of (key, version, valid, payload). Each key keeps
    one row of state, which a batch touches only if it has versions of the key;
    versions that change nothing come to nothing. A key with very many versions
    is reduced before the shuffle.
    """
    known = versions.select("key", "version", "valid", "payload").filter("key IS NOT NULL AND version IS NOT NULL")
    return known.mapInPandas(_decisive, _VERSIONS).groupBy("key").transformWithStateInPandas(
        _LastGood(), "key string, latest bigint, used bigint, payload string", "Append", "None"
    )


def settings_view(changes: DataFrame) -> DataFrame:
    """The settings in force, from all changes so far: both versions of a key only ever rise."""
    last = changes.groupBy("key").agg(F.max(F.struct("latest", "used", "payload")).alias("v")).select("key", "v.*")
    newest = last.select("key", F.col("latest").alias("version"), F.lit(False).alias("valid"), F.lit(None).cast("string").alias("payload"))
    good = last.filter("used IS NOT NULL").select("key", F.col("used").alias("version"), F.lit(True).alias("valid"), "payload")
    return last_good(newest.unionByName(good), ["key"])
