"""Handoffs: who gains and who loses assignments as nodes come and go.

The owners of every assignment are kept with their scores. A node that joins can
only win where it scores above the last owner, so it is scored alone against
the assignments of its services; a node that leaves can only be missed by the
assignments it owns, and only those are ranked anew over the fleet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.operators.liveness import offers
from quayside.operators.placement import best_owners, rank_nodes
from quayside.session import settle

KEYS = ["db_url", "service", "target"]
_NODES = "node_id string, services array<string>"
_EVENTS = "db_url string, service string, target string, lost array<string>, gained array<string>"


class HandoffStream:
    """Handoff events per batch of liveness changes.

    The rankings that change are written per batch; every ``full_every``
    batches all of them are, so a batch reads a bounded number of tables. A
    batch that runs again reads what it read before and overwrites its own.
    """

    def __init__(self, spark: SparkSession, path: str, assignments: DataFrame, full_every: int = 16):
        """``assignments`` is (db_url, service, target, k), each once."""
        self.spark, self.path, self.full_every = spark, path.rstrip("/"), full_every
        self.assignments = assignments.select(*KEYS, F.col("k").cast("int").alias("k"))
        self.schema = T.StructType.fromDDL("db_url string, service string, target string, k int, owners array<struct<node_id: string, score: string>>")

    def _folder(self, table: str, batch_id: int) -> str:
        return f"{self.path}/{table}/micro_batch={batch_id}"

    def nodes(self, batch_id: int) -> DataFrame:
        """The live nodes after a batch."""
        if batch_id < 0:
            return self.spark.createDataFrame([], _NODES)
        return self.spark.read.schema(_NODES).parquet(self._folder("nodes", batch_id))

    def owners(self, batch_id: int) -> DataFrame:
        """The owners of every assignment after a batch, best first, with their scores."""
        if batch_id < 0:
            return self.assignments.withColumn("owners", F.array().cast(self.schema["owners"].dataType))
        full = batch_id - batch_id % self.full_every
        folders = [self._folder("owners", batch) for batch in range(full, batch_id + 1)]
        schema = T.StructType([*self.schema.fields, T.StructField("micro_batch", T.IntegerType())])
        rows = self.spark.read.option("basePath", f"{self.path}/owners").schema(schema).parquet(*folders)
        return rows.groupBy(*KEYS, "k").agg(F.max_by("owners", "micro_batch").alias("owners"))

    def events(self) -> DataFrame:
        """(db_url, service, target, lost, gained, micro_batch) of all batches."""
        return self.spark.read.schema(f"{_EVENTS}, micro_batch int").parquet(f"{self.path}/events")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """``batch`` is (node_id, change, at, services) as :func:`liveness_changes` emits them."""
        before = self.nodes(batch_id - 1)
        newest = settle(
            batch.groupBy("node_id").agg(F.max(F.struct("at", "change", "services")).alias("c"))
            .select("node_id", "c.change", "c.services"),
            "node-changes",
        )
        after = before.join(newest, "node_id", "left_anti").unionByName(newest.filter("change <> 'down'").select("node_id", "services"))
        after.write.mode("overwrite").parquet(self._folder("nodes", batch_id))
        after = self.nodes(batch_id)
        was, now = offers(before).distinct(), offers(after).distinct()
        left = settle(was.join(now, ["node_id", "service"], "left_anti"), "left-nodes")
        joined = settle(now.join(was, ["node_id", "service"], "left_anti"), "joined-nodes")

        held = settle(self.owners(batch_id - 1).withColumn("_id", F.monotonically_increasing_id()), "owners")
        # Owners that have left, by the assignments they leave.
        owned = held.select("_id", "service", F.explode("owners.node_id").alias("node_id"))
        missed = settle(owned.join(left, ["node_id", "service"], "left_semi").select("_id").distinct(), "missed")
        anew = rank_nodes(held.join(missed, "_id", "left_semi").select("_id", *KEYS, "k"), after)
        rest = held.join(missed, "_id", "left_anti").join(joined.select("service").distinct(), "service", "left_semi")
        only = joined.groupBy("node_id").agg(F.collect_set("service").alias("services"))
        won = rank_nodes(rest.select("_id", *KEYS, "k"), only).select("_id", F.col("owners").alias("_won"))
        merged = rest.join(won, "_id").withColumn("owners", best_owners(F.concat("owners", "_won"), F.col("k")))
        fresh = anew.select("_id", *KEYS, "k", "owners").unionByName(merged.select("_id", *KEYS, "k", "owners"))
        compared = settle(fresh.join(held.select("_id", F.col("owners").alias("_old")), "_id").filter(F.col("owners") != F.col("_old")), "handoffs")

        lost = F.array_sort(F.array_except("_old.node_id", "owners.node_id"))
        gained = F.array_sort(F.array_except("owners.node_id", "_old.node_id"))
        events = compared.select(*KEYS, lost.alias("lost"), gained.alias("gained")).filter((F.size("lost") > 0) | (F.size("gained") > 0))
        events.write.mode("overwrite").parquet(self._folder("events", batch_id))
        changed = compared.select(*self.schema.names)
        if batch_id % self.full_every == 0:
            changed = changed.unionByName(held.join(compared.select("_id"), "_id", "left_anti").select(*self.schema.names))
        changed.write.mode("overwrite").parquet(self._folder("owners", batch_id))
