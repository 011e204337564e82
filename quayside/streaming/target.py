"""What a target holds, as a snapshot and the changes since: what a continuous job keeps instead of reading history again.

Every batch writes the rows it adds and the keys it removes, and a pointer to
the snapshot they belong to. The state before a batch is that snapshot with the
changes of the batches in between. When they have become many they are folded
into a new snapshot. Nothing is changed in place: a batch that runs again reads
what it read before and overwrites only what it wrote itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.operators.snapshot import Catalog
from quayside.session import settle

PAIR = ["db_key", "target"]
# What tells the rows of each table apart.
KEYS = {
    "manifests": [*PAIR, "manifest_id"],
    "objects": [*PAIR, "manifest_id", "kind", "object_name"],
    "checkpoints": [*PAIR, "manifest_id", "cp_id"],
    "listing": [*PAIR, "kind", "object_name"],
}
# Objects and checkpoints go with their manifest, so nothing removes them by themselves.
REMOVED = ("manifests", "listing")
_NEVER = -1


def side_by_side(jobs: Iterable[Callable[[], Any]]) -> list:
    """Run a few independent Spark jobs at the same time; small ones are mostly waiting."""
    with ThreadPoolExecutor(4) as pool:
        return [done.result() for done in [pool.submit(job) for job in jobs]]


class TargetLog:
    """The manifests, objects, checkpoints and listing of all targets, batch by batch."""

    def __init__(self, spark: SparkSession, path: str, dest: Catalog, listing: DataFrame, fold_batches: int = 16, fold_rows: int = 1_000_000):
        """``dest`` and ``listing`` are the target as it was before the first batch; they are the first snapshot."""
        self.spark, self.path = spark, path.rstrip("/")
        self.first = {"manifests": dest.manifests, "objects": dest.objects, "checkpoints": dest.checkpoints, "listing": listing}
        self.fold_batches, self.fold_rows = fold_batches, fold_rows

    def _folder(self, kind: str, table: str, batch_id: int) -> str:
        return f"{self.path}/{kind}/{table}/micro_batch={batch_id}"

    def _changes(self, kind: str, table: str, after: int, until: int, names: list[str]) -> DataFrame:
        """Added or removed rows of the batches in (after, until], with their ``micro_batch``."""
        schema = self.first[table].select(*names).schema
        if after >= until:
            return self.spark.createDataFrame([], schema).withColumn("micro_batch", F.lit(0))
        # Only the folders since the snapshot are looked at, however many there have been.
        folders = [self._folder(kind, table, batch) for batch in range(after + 1, until + 1)]
        return self.spark.read.option("basePath", f"{self.path}/{kind}/{table}").schema(schema.add("micro_batch", T.IntegerType())).parquet(*folders)

    def snapshot_before(self, batch_id: int) -> tuple[int, int]:
        """(batch that the snapshot includes, rows changed since) for the state before a batch."""
        if batch_id == 0:
            return _NEVER, 0
        row = self.spark.read.parquet(f"{self.path}/pointer/micro_batch={batch_id - 1}").first()
        return row["snapshot"], row["changed"]

    def table(self, name: str, until: int, snapshot: int, only: DataFrame | None = None, pruned: bool = True) -> DataFrame:
        """A table as it is after batch ``until``, or before its removals, for the databases ``only``, or for all."""
        first = self.first[name]
        base = first
        if snapshot != _NEVER:
            base = self.spark.read.schema(first.schema).parquet(self._folder("snapshots", name, snapshot))
        keys = KEYS[name]
        added = self._changes("added", name, snapshot, until, first.columns)
        rows = base.withColumn("micro_batch", F.lit(_NEVER)).unionByName(added)
        if only is not None:
            rows = rows.join(only.select("db_key"), "db_key", "left_semi")
        removed_until = until if pruned else until - 1
        if name not in REMOVED or snapshot >= removed_until:
            return rows.select(*first.columns)
        gone = self._changes("removed", name, snapshot, removed_until, keys)
        if only is not None:
            gone = gone.join(only.select("db_key"), "db_key", "left_semi")
        # What a batch removes, it removes from what it has added, too.
        last = gone.groupBy(*keys).agg(F.max("micro_batch").alias("_gone"))
        kept = rows.join(last, keys, "left").filter(F.col("_gone").isNull() | (F.col("micro_batch") > F.col("_gone")))
        return kept.select(*first.columns)

    def state(self, until: int, snapshot: int, only: DataFrame | None = None, pruned: bool = True) -> tuple[Catalog, DataFrame]:
        """The target's catalog and listing after batch ``until``, or before its removals.

        The objects and checkpoints of removed manifests are removed with them; a snapshot
        has none of others, so until something is removed they are taken as they are.
        """
        tables = {name: self.table(name, until, snapshot, only, pruned) for name in KEYS}
        if only is not None:
            # A row per restore point, which every step of a pass asks for.
            tables["manifests"] = settle(tables["manifests"], "target-manifests")
        if snapshot >= (until if pruned else until - 1):
            return Catalog(tables["manifests"], tables["objects"], tables["checkpoints"]), tables["listing"]
        there = tables["manifests"].select(*KEYS["manifests"])
        objects, checkpoints = (tables[name].join(there, KEYS["manifests"], "left_semi") for name in ("objects", "checkpoints"))
        return Catalog(tables["manifests"], objects, checkpoints), tables["listing"]

    def write(self, batch_id: int, kind: str, changes: dict[str, DataFrame]) -> None:
        """Write the ``added`` rows, or the keys ``removed``, of a batch."""
        def put(name: str, changed: DataFrame) -> None:
            schema = self.first[name].select(*(self.first[name].columns if kind == "added" else KEYS[name])).schema
            rows = self.spark.createDataFrame([], schema).unionByName(changed, allowMissingColumns=True).select(*schema.names)
            rows.write.mode("overwrite").parquet(self._folder(kind, name, batch_id))

        side_by_side([partial(put, name, changed) for name, changed in changes.items()])

    def close(self, batch_id: int) -> None:
        """End a batch: point the next one to its snapshot, which is a new one if the changes have become many."""
        snapshot, changed = self.snapshot_before(batch_id)
        folders = [self._folder("added", name, batch_id) for name in KEYS] + [self._folder("removed", name, batch_id) for name in REMOVED]
        changed += self.spark.read.schema("db_key bigint").parquet(*folders).count()
        if batch_id - snapshot >= self.fold_batches or changed >= self.fold_rows:
            catalog, listing = self.state(batch_id, snapshot)
            tables = {"manifests": catalog.manifests, "objects": catalog.objects, "checkpoints": catalog.checkpoints, "listing": listing}
            side_by_side([
                partial(rows.write.mode("overwrite").parquet, self._folder("snapshots", name, batch_id)) for name, rows in tables.items()
            ])
            snapshot, changed = batch_id, 0
        pointer = self.spark.createDataFrame([(snapshot, changed)], "snapshot int, changed bigint")
        pointer.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pointer/micro_batch={batch_id}")
