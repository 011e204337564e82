"""Report rows as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(report: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, response): each row as a JSON object; absent values are left out."""
    return report.select(*keys, F.to_json(F.struct(*report.columns)).alias("response"))
