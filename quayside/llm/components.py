"""Connected components of an edge table, without bringing it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.session import settle


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per node of ``edges``: ``node`` and ``root``, the smallest node reachable from it.

    Every round takes the smallest label among a node's neighbours and then
    follows the label once, which halves the way to the root. All tables of a
    round are written before they are joined, so a node with very many edges
    is split by adaptive execution, and a lost executor costs a re-read. The
    labels only fall; the rounds end when their sum stays.
    """
    both = settle(
        edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).distinct(), "edges"
    )
    labels = settle(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")), "labels")
    total = _total(labels)
    while True:
        seen = both.join(labels.withColumnsRenamed({"x": "y", "label": "of_y"}), "y").select("x", F.col("of_y").alias("label"))
        lowest = settle(labels.union(seen).groupBy("x").agg(F.min("label").alias("label")), "labels")
        labels = settle(
            lowest.join(lowest.select(F.col("x").alias("label"), F.col("label").alias("next")), "label").select("x", F.col("next").alias("label")),
            "labels",
        )
        before, total = total, _total(labels)
        if before == total:
            return labels.select(F.col("x").alias("node"), F.col("label").alias("root"))


def _total(labels: DataFrame):
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
