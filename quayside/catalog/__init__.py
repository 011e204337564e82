"""Registered queries over the given tables, each with an SQL check if it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quayside.catalog import fleet_queries, mirror_queries, name_queries, stream_queries  # noqa: F401
from quayside.catalog.fixtures import Fixtures
from quayside.catalog.registration import ORACLES, QUERIES
from quayside.session import ship_package


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            return fn(Fixtures(spark, sf_dir))

        run.__doc__ = fn.__doc__
        return run

    return {name: bind(fn) for name, fn in QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
