"""Duration text columns such as ``1h 30m``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nanoseconds per unit. A month is 30.44 days, a year 365.25 days.
UNIT_NANOS = {
    1: ["nanos", "nsec", "ns"],
    1_000: ["usec", "us", "µs"],
    1_000_000: ["millis", "msec", "ms"],
    1_000_000_000: ["seconds", "second", "secs", "sec", "s"],
    60_000_000_000: ["minutes", "minute", "mins", "min", "m"],
    3_600_000_000_000: ["hours", "hour", "hrs", "hr", "h"],
    86_400_000_000_000: ["days", "day", "d"],
    604_800_000_000_000: ["weeks", "week", "wks", "wk", "w"],
    2_630_016_000_000_000: ["months", "month", "M"],
    31_557_600_000_000_000: ["years", "year", "yrs", "yr", "y"],
}

_TERM = r"([0-9]+)\s*([A-Za-zµ]+)"


def duration_nanos(text: Column) -> Column:
    """Nanoseconds as BIGINT; NULL for text that is not a duration."""
    units = F.create_map(
        *[F.lit(x) for nanos, names in UNIT_NANOS.items() for n in names for x in (n, nanos)]
    )
    numbers = F.regexp_extract_all(text, F.lit(_TERM), 1)
    names = F.regexp_extract_all(text, F.lit(_TERM), 2)
    # A number beyond BIGINT, an unknown unit or an overflowing product turns
    # the term, and with it the sum, into NULL.
    terms = F.zip_with(
        numbers, names, lambda n, u: F.try_multiply(n.try_cast("bigint"), F.try_element_at(units, u))
    )
    total = F.aggregate(terms, F.lit(0).cast("bigint"), lambda acc, x: F.try_add(acc, x))
    return F.when(text.rlike(r"^\s*(?:[0-9]+\s*[A-Za-zµ]+\s*)+\z"), total).when(
        F.trim(text) == "0", F.lit(0).cast("bigint")
    )


def duration_seconds(text: Column) -> Column:
    """Seconds as DOUBLE; NULL for text that is not a duration."""
    return duration_nanos(text) / F.lit(1_000_000_000)
