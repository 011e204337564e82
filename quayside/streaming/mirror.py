"""Continuous mirroring: pass, prune and tail for every database with news, batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.names import object_class, wal_name
from quayside.operators.ordered import contiguous_from
from quayside.operators.sets import looked_up
from quayside.operators.snapshot import Catalog
from quayside.plans.mirror import PAIR, commit_order, committed_rows, sync_plan, tail_starts
from quayside.plans.retention import delete_order, prune_plan
from quayside.session import settle
from quayside.streaming.target import TargetLog, side_by_side

_LOGS = {
    "copies": "db_key bigint, target string, kind string, object_name string",
    "commits": "db_key bigint, target string, manifest_id bigint, commit_seq bigint",
    "deletes": "db_key bigint, target string, kind string, object_name string, phase bigint",
    "tails": "db_key bigint, target string, from_id bigint, to_id bigint",
}


def needed_at_source(source: Catalog, newest: DataFrame) -> Catalog:
    """The part of a source that a pass or prune can ask for: the newest manifests, and what their checkpoints pin.

    ``newest`` is (db_key, manifest_id), one per database. The rest of a
    history is filtered out where it is scanned.
    """
    pins = source.checkpoints.join(newest, ["db_key", "manifest_id"], "left_semi").select("db_key", F.col("pinned_id").alias("manifest_id"))
    needed = settle(newest.select("db_key", "manifest_id").unionByName(pins).distinct(), "mirror-needed")
    return Catalog(*side_by_side([
        partial(settle, rows.join(needed, ["db_key", "manifest_id"], "left_semi"), "mirror-needed")
        for rows in (source.manifests, source.objects, source.checkpoints)
    ]))


class ContinuousMirror:
    """One job for all pairs whose source got a manifest in a batch.

    Databases without news are dropped before anything else is read. The
    target is known from a snapshot and the changes since (:class:`TargetLog`),
    so neither its history nor the source's is read again: what is committed is
    added as it is committed, from the few manifests that the pass needed. A
    manifest or object that the target has is neither committed nor copied
    again.
    """

    def __init__(self, spark: SparkSession, path: str, source: Catalog, dest: Catalog, dest_listing: DataFrame,
                 pairs: DataFrame, now: Column, policy: DataFrame | None = None, source_wals: DataFrame | None = None, **fold):
        """``policy`` as for :func:`prune_plan`, without it nothing is pruned; ``source_wals`` is (db_key, wal_id), repeated or not, without it nothing is tailed."""
        self.spark, self.path = spark, path.rstrip("/")
        self.source, self.pairs, self.now, self.policy, self.wals = source, pairs, now, policy, source_wals
        self.target = TargetLog(spark, f"{path}/target", dest, dest_listing, **fold)

    def _logged(self, name: str, rows: DataFrame | None, batch_id: int) -> DataFrame:
        schema = _LOGS[name]
        if rows is None:
            rows = self.spark.createDataFrame([], schema)
        folder = f"{self.path}/log/{name}/micro_batch={batch_id}"
        rows.select(*(part.split()[0] for part in schema.split(", "))).write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(schema).parquet(folder)

    def log(self, name: str) -> DataFrame:
        """What all batches did: ``copies``, ``commits``, ``deletes`` or ``tails``, with their ``micro_batch``."""
        return self.spark.read.schema(f"{_LOGS[name]}, micro_batch int").parquet(f"{self.path}/log/{name}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """``batch`` is (db_key, manifest_id): manifests that appeared at sources."""
        news = settle(batch.groupBy("db_key").agg(F.max("manifest_id").alias("manifest_id")), "mirror-news")
        snapshot, _ = self.target.snapshot_before(batch_id)
        dest, listing = self.target.state(batch_id - 1, snapshot, news)
        source = needed_at_source(self.source, news)
        pairs = self.pairs.join(news.select("db_key"), "db_key", "left_semi")

        plan = sync_plan(source, dest, listing, pairs, self.now)
        fresh = plan.commits.drop("commit_seq").join(dest.manifests.select(*PAIR, "manifest_id"), [*PAIR, "manifest_id"], "left_anti")
        named = [*PAIR, "kind", "object_name"]
        # Of the listing, which is large, only what the copies ask for is compared.
        there = looked_up(listing, plan.copies, named)
        commits, copies = side_by_side([
            partial(self._logged, "commits", commit_order(fresh, PAIR), batch_id),
            partial(self._logged, "copies", plan.copies.join(there, named, "left_anti"), batch_id),
        ])
        manifests, objects, checkpoints, copied = committed_rows(source, commits, copies, self.now)
        tails, tailed = self._tail(dest.manifests, manifests, listing.unionByName(copied, allowMissingColumns=True), pairs)
        self._logged("tails", tails, batch_id)
        added = {"manifests": manifests.withColumn("readable", F.lit(True)), "objects": objects, "checkpoints": checkpoints,
                 "listing": copied if tailed is None else copied.unionByName(tailed)}
        self.target.write(batch_id, "added", added)

        # Pruning looks at the state that the pass has made.
        deletes = None
        if self.policy is not None:
            dest, listing = self.target.state(batch_id, snapshot, news, pruned=False)
            policy = self.policy.join(pairs.select(*PAIR), PAIR, "left_semi")
            deletes = delete_order(prune_plan(source, dest, listing, policy, self.now, only_deletes=True))
        deletes = self._logged("deletes", deletes, batch_id)
        self.target.write(batch_id, "removed", {
            "manifests": deletes.filter("kind = 'manifest'").withColumn("manifest_id", object_class(F.concat(F.lit("/"), F.col("object_name")))["id"].cast("bigint")),
            "listing": deletes.filter("kind <> 'manifest'"),
        })
        self.target.close(batch_id)

    def _tail(self, before: DataFrame, committed: DataFrame, listing: DataFrame, pairs: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """Dense WAL ids after what the target has, as runs and as rows of its listing."""
        if self.wals is None:
            return None, None
        wanted = [*PAIR, "manifest_id", "next_wal_sst_id"]
        manifests = before.select(*wanted).unionByName(committed.select(*wanted)).join(pairs.select(*PAIR), PAIR, "left_semi")
        floors = settle(tail_starts(manifests, listing), "tail-floors")
        ids = self.wals.join(floors, "db_key").filter(F.col("wal_id") >= F.col("floor")).select(*PAIR, "wal_id").distinct()
        reached = contiguous_from(ids, floors, PAIR, "wal_id", "floor").filter(F.col("next") > F.col("floor"))
        runs = settle(reached.select(*PAIR, F.col("floor").alias("from_id"), (F.col("next") - 1).alias("to_id")), "tail-runs")
        rows = runs.select(*PAIR, F.explode(F.sequence("from_id", "to_id")).alias("wal_id")).select(
            *PAIR, F.lit("wal").alias("kind"), wal_name(F.col("wal_id")).alias("object_name"), "wal_id", self.now.alias("last_modified")
        )
        return runs, rows


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that has arrived, then stop; call again to go on.

    A long-running service uses the same function with a processing-time
    trigger instead.
    """
    query = (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
