"""Row-level rules shared by the jobs. All bounds match strictness for strictness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros_between(later: Column, earlier: Column) -> Column:
    """``later - earlier`` in microseconds, for either timestamp type."""
    return F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))


def age_micros(now: Column, modified: Column) -> Column:
    """Age in microseconds; a timestamp from the future has age zero."""
    return F.greatest(F.lit(0).cast("bigint"), micros_between(now, modified))


def age_seconds(now: Column, modified: Column) -> Column:
    """Age in whole seconds, rounded down."""
    return F.floor(age_micros(now, modified) / F.lit(1_000_000)).cast("bigint")


def is_live(age: Column, timeout_seconds: float) -> Column:
    """Strictly younger than the timeout. ``age`` is in microseconds."""
    return age < F.lit(int(timeout_seconds * 1_000_000))


def checkpoint_live(expire_time: Column, now: Column) -> Column:
    """A checkpoint without expiry lives; otherwise it must expire after now."""
    return expire_time.isNull() | (expire_time > now)


def exclusion_reason(external_dbs: Column, wal_store: Column) -> Column:
    """Why a source cannot be mirrored, NULL if it can."""
    return F.when(
        F.coalesce(F.size(external_dbs), F.lit(0)) > 0, F.lit("clone of other databases")
    ).when(wal_store.isNotNull(), F.lit("separate WAL object store"))


def fingerprint(*columns: Column) -> Column:
    """Change detection over settings; compare within one release only."""
    return F.xxhash64(F.to_json(F.struct(*columns)))


def behind(source: Column, dest: Column) -> Column:
    """How far ``dest`` trails ``source``, never negative; all of it if absent."""
    gap = F.greatest(F.lit(0).cast("bigint"), source - F.coalesce(dest, F.lit(0).cast("bigint")))
    return F.when(source.isNotNull(), gap)
