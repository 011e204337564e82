"""The fleet views the registered queries run on, derived from the given tables.

Each view exists twice: as a DataFrame here and as SQL in :data:`SQL`, written
separately so that one checks the other.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.names import compacted_name, wal_name
from quayside.operators.snapshot import Catalog, window_objects
from quayside.session import deal_shuffles

HEARTBEAT_NOW = "2024-01-30 18:00:00"
HEARTBEAT_TIMEOUT = 36_000
MIRROR_NOW = "2001-08-01 00:00:00"
KEEP_SECONDS = 100 * 86_400.0
MIN_AGE_SECONDS = 300.0
TARGET = "dr"


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}
        self._most_rows = 0

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            # Counted from the files' footers.
            self._most_rows = max(self._most_rows, self._tables[name].count())
            deal_shuffles(self.spark, self._most_rows)
        return self._tables[name]

    @property
    def heartbeat_now(self):
        return ntz(HEARTBEAT_NOW)

    @property
    def mirror_now(self):
        return ntz(MIRROR_NOW)

    # ------------------------------------------------------------- the fleet

    @cached_property
    def database(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("db_key"),
            F.concat(
                F.lit("s3://data/tenant"), F.col("c_nationkey").cast("string"), F.lit("/db"),
                F.col("c_custkey").cast("string"),
            ).alias("db_url"),
            "c_nationkey",
            "c_mktsegment",
        )

    @staticmethod
    def heartbeat_rows(events: DataFrame, *others: str) -> DataFrame:
        letters = (
            F.when(F.col("event_type") == "click", "g").when(F.col("event_type") == "view", "c")
            .when(F.col("event_type") == "purchase", "w").when(F.col("event_type") == "signup", "m")
            .otherwise("x")
        )
        node = F.concat(F.lit("node-"), F.col("user_id").cast("string"))
        return events.select(
            *others, node.alias("node_id"), letters.alias("letters"), "ts",
            F.concat(F.lit("nodes/"), node, F.lit("."), letters, F.lit(".json")).alias("path"),
        )

    @cached_property
    def heartbeat_listing(self) -> DataFrame:
        """Object listing rows (path, last_modified) under ``nodes/``; some lie in the future."""
        return self.heartbeat_rows(self.table("events")).groupBy("path").agg(F.max("ts").alias("last_modified"))

    @cached_property
    def target(self) -> DataFrame:
        key = F.col("n_nationkey")
        text = key.cast("string")
        return self.table("nation").select(
            F.concat(F.lit("t"), text).alias("target"),
            F.concat(F.lit("s3://data/tenant"), text).alias("source_prefix"),
            F.when(key % 7 == 0, F.lit("s3://dr/shared"))
            .otherwise(F.concat(F.lit("s3://dr"), F.col("n_regionkey").cast("string"), F.lit("/mirrors/tenant"), text))
            .alias("url"),
            (key % 11 == 0).alias("disabled"),
        )

    @cached_property
    def target_with_exact(self) -> DataFrame:
        """The targets and, per region, one without a prefix; one of those is enabled.

        The url of such a target is that of a registered database.
        """
        databases = self.database.select((F.col("db_key") / 25).alias("_at"), "db_url")
        exact = self.table("region").join(databases, F.col("r_regionkey") == F.col("_at")).select(
            F.concat(F.lit("all"), F.col("r_regionkey").cast("string")).alias("target"),
            F.lit(None).cast("string").alias("source_prefix"),
            F.col("db_url").alias("url"),
            (F.col("r_regionkey") != 1).alias("disabled"),
        )
        return self.target.unionByName(exact)

    @cached_property
    def target_override(self) -> DataFrame:
        """Per-database target overrides: some move a target, some tune or disable it."""
        key, nation = F.col("c_custkey"), F.col("c_nationkey")
        kind = key % 9
        return self.table("customer").select(
            key.alias("db_key"),
            F.when(kind <= 3, F.concat(F.lit("t"), nation.cast("string")))
            .otherwise(F.concat(F.lit("own"), (key % 4).cast("string"))).alias("target"),
            F.when(kind == 0, F.concat(F.lit("gs://own/db"), key.cast("string"))).alias("url"),
            F.lit(None).cast("string").alias("source_prefix"),
            F.when(kind == 1, F.lit(True)).alias("disabled"),
            F.when(kind == 2, F.lit("periodic")).alias("mode"),
            F.when(kind == 3, (key % 5).cast("bigint")).alias("copy_parallelism"),
        )

    @cached_property
    def override(self) -> DataFrame:
        key, segment = F.col("c_custkey"), F.col("c_mktsegment")
        services = (
            F.when(segment == "MACHINERY", F.array(F.lit("gc")))
            .when(segment == "HOUSEHOLD", F.array(F.lit("gc"), F.lit("compaction-workers")))
            .when(segment == "BUILDING", F.array().cast("array<string>"))
        )
        return self.table("customer").select(
            key.alias("db_key"),
            F.when(key % 3 == 0, key % 4 + 1).cast("bigint").alias("compaction_workers_count"),
            services.alias("services"),
            F.when(key % 5 == 0, key % 900).cast("double").alias("gc_manifest_min_age_s"),
        )

    @cached_property
    def fleet(self) -> DataFrame:
        """The fleet policy: one row computed from the parts table."""
        return self.table("part").agg(
            (F.max("p_size") % 4 + 1).cast("bigint").alias("compaction_workers_count"),
            (F.min("p_size") * 120).cast("double").alias("gc_manifest_min_age_s"),
            (F.max("p_size") + 10).cast("double").alias("compactor_coordinator_poll_interval_s"),
        )

    # ------------------------------------------------------------ snapshots

    @cached_property
    def manifest(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").select(
            (F.col("o_custkey") % 20).alias("db_key"),
            key.alias("manifest_id"),
            F.col("o_orderdate").alias("last_modified"),
            key.alias("replay_after_wal_id"),
            (key + 1 + key % 4).alias("next_wal_sst_id"),
            key.alias("last_l0_seq"),
        )

    @cached_property
    def sst(self) -> DataFrame:
        orders, lines = self.table("orders"), self.table("lineitem")
        key = F.col("o_orderkey")
        number = key - key % 200 + F.col("l_linenumber")
        return (
            orders.join(lines, F.col("l_orderkey") == key)
            .select(
                (F.col("o_custkey") % 20).alias("db_key"), key.alias("manifest_id"),
                F.lpad(number.cast("string"), 26, "0").alias("ulid"),
            )
            .distinct()
        )

    @cached_property
    def checkpoint(self) -> DataFrame:
        """A carrier lists the urgent orders of its database up to 400 ids back.

        Both sides are cut into 400-id buckets, so the range condition becomes
        an equi-join on two buckets.
        """
        orders = self.table("orders")
        carriers = orders.select(
            (F.col("o_custkey") % 20).alias("db_key"), F.col("o_orderkey").alias("manifest_id"),
            F.floor(F.col("o_orderkey") / 400).alias("_bucket"),
        )
        bucket = F.floor(F.col("o_orderkey") / 400)
        pins = orders.filter(F.col("o_orderpriority") == "1-URGENT").select(
            (F.col("o_custkey") % 20).alias("db_key"),
            F.col("o_orderkey").alias("pinned_id"),
            F.col("o_orderdate").alias("create_time"),
            F.when(F.col("o_orderstatus") == "O", F.lit(None).cast("timestamp_ntz"))
            .when(F.col("o_orderstatus") == "P", ntz("2030-01-01 00:00:00"))
            .otherwise(ntz("1999-01-01 00:00:00")).alias("expire_time"),
            F.explode(F.array(bucket, bucket + 1)).alias("_bucket"),
        )
        ahead = F.col("manifest_id") - F.col("pinned_id")
        name = F.when(F.col("pinned_id") % 10 == 0, F.lit("mirror:" + TARGET))
        return carriers.join(pins, ["db_key", "_bucket"]).filter((ahead > 0) & (ahead <= 400)).select(
            "db_key", "manifest_id",
            F.concat(F.lit("cp-"), F.col("pinned_id").cast("string")).alias("cp_id"),
            "pinned_id", "create_time", "expire_time", name.alias("name"),
        )

    @cached_property
    def nested_manifest(self) -> DataFrame:
        """Manifests with l0, runs and segments, built from each order row."""
        key = F.col("o_orderkey")

        def views(count, offset):
            def view(i):
                number = key - key % 50 + offset + i
                return F.struct(
                    F.when(number % 13 != 0, F.lpad(number.cast("string"), 26, "0")).alias("ulid"),
                    F.when(number % 13 == 0, number).alias("wal_id"),
                )

            return F.when(count > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), count), view)).otherwise(
                F.array().cast("array<struct<ulid:string,wal_id:bigint>>")
            )

        return self.table("orders").select(
            (F.col("o_custkey") % 20).alias("db_key"),
            key.alias("manifest_id"),
            views(key % 3, F.lit(0)).alias("l0"),
            F.array(
                F.struct(views(F.lit(2).cast("bigint"), F.lit(1)).alias("ssts")),
                F.struct(views(key % 4, F.lit(5)).alias("ssts")),
            ).alias("runs"),
            F.array(
                F.struct(
                    views(key % 2, F.lit(20)).alias("l0"),
                    F.array(F.struct(views(key % 5, F.lit(21)).alias("ssts"))).alias("runs"),
                )
            ).alias("segments"),
            key.alias("replay_after_wal_id"),
            (key + 1 + key % 4).alias("next_wal_sst_id"),
        )

    @cached_property
    def wal(self) -> DataFrame:
        return self.table("lineitem").select(
            (F.col("l_suppkey") % 4).alias("db_key"), F.col("l_orderkey").alias("wal_id")
        ).distinct()

    @cached_property
    def compaction(self) -> DataFrame:
        code = F.concat("l_returnflag", "l_linestatus")
        status = (
            F.when(code == "AF", "Submitted").when(code == "AO", "Scheduled").when(code == "NF", "Running")
            .when(code == "NO", "Compacted").when(code == "RF", "Completed").otherwise("Failed")
        )
        return self.table("lineitem").select(F.col("l_suppkey").alias("db_key"), status.alias("status"))

    @cached_property
    def seq(self) -> DataFrame:
        """A shared series of sequence numbers and times, with steps between samples."""
        return self.table("events").select((F.col("event_id") * 7 + 3).alias("seq"), "ts")

    def _top_order(self):
        return self.table("orders").agg(F.max("o_orderkey").alias("top")).scalar()

    @cached_property
    def src_manifest(self) -> DataFrame:
        return self.manifest.filter((F.col("db_key") != 5) | (F.col("manifest_id") < self._top_order() - 500))

    @cached_property
    def dst_manifest(self) -> DataFrame:
        """Target manifests; a few cannot be read back (``readable``)."""
        return (
            self.manifest.filter(
                (F.col("db_key") != 7)
                & ((F.col("db_key") == 3) | (F.col("manifest_id") < self._top_order() - 200))
            )
            .withColumn("target", F.lit(TARGET))
            .withColumn("readable", F.col("manifest_id") % 4999 != 17)
        )

    def _objects(self, manifests: DataFrame, keys: list[str]) -> DataFrame:
        number = F.col("manifest_id") - F.col("manifest_id") % 200 + F.col("l_linenumber")
        lines = self.table("lineitem").select(F.col("l_orderkey").alias("manifest_id"), "l_linenumber")
        compacted = (
            manifests.select(*keys, "manifest_id").join(lines, "manifest_id").distinct()
            .select(
                *keys, "manifest_id", F.lit("compacted").alias("kind"),
                compacted_name(F.lpad(number.cast("string"), 26, "0")).alias("object_name"),
            )
        )
        return compacted.unionByName(window_objects(manifests, tuple(keys)))

    @cached_property
    def source(self) -> Catalog:
        checkpoints = self.checkpoint.join(
            self.src_manifest.select("db_key", "manifest_id"), ["db_key", "manifest_id"], "left_semi"
        )
        return Catalog(self.src_manifest, self._objects(self.src_manifest, ["db_key"]), checkpoints)

    @cached_property
    def dest(self) -> Catalog:
        checkpoints = self.checkpoint.join(
            self.dst_manifest.select("db_key", "target", "manifest_id"), ["db_key", "manifest_id"]
        )
        return Catalog(self.dst_manifest, self._objects(self.dst_manifest, ["db_key", "target"]), checkpoints)

    @cached_property
    def pair(self) -> DataFrame:
        """Every database with one target; the copier varies by database."""
        key = F.col("db_key")
        copier = F.when(key % 3 == 0, "builtin").when(key % 3 == 1, "external").otherwise("rclone")
        return self.manifest.select("db_key").distinct().select(
            "db_key", F.lit(TARGET).alias("target"), copier.alias("copier")
        )

    @cached_property
    def dst_object(self) -> DataFrame:
        """The target's listing: compacted objects with holes, and WAL objects."""
        # Names are made last: numbers are shuffled and grouped for less.
        number = F.col("manifest_id") - F.col("manifest_id") % 200 + F.col("l_linenumber")
        lines = self.table("lineitem").select(F.col("l_orderkey").alias("manifest_id"), "l_linenumber")
        compacted = (
            self.manifest.select("db_key", "manifest_id", "last_modified")
            .filter((F.col("db_key") != 7) & (F.col("manifest_id") < self._top_order() - 100))
            .join(lines, "manifest_id").withColumn("number", number).filter("number % 7 <> 3")
            .groupBy("db_key", "number").agg(F.min("last_modified").alias("last_modified"))
            .select(
                "db_key", F.lit("compacted").alias("kind"),
                compacted_name(F.lpad(F.col("number").cast("string"), 26, "0")).alias("object_name"),
                F.lit(None).cast("bigint").alias("wal_id"), "last_modified",
            )
        )
        wals = (
            self.table("lineitem")
            .groupBy((F.col("l_suppkey") % 20).alias("db_key"), F.col("l_orderkey").alias("wal_id"))
            .agg(F.min("l_shipdate").alias("last_modified"))
            .filter(F.col("db_key") != 7)
            .select(
                "db_key", F.lit("wal").alias("kind"), wal_name(F.col("wal_id")).alias("object_name"),
                "wal_id", "last_modified",
            )
        )
        return compacted.unionByName(wals).withColumn("target", F.lit(TARGET))

    @cached_property
    def src_wal_rows(self) -> DataFrame:
        """The source's WAL ids as they are read, some of them repeated."""
        return self.table("lineitem").select((F.col("l_suppkey") % 19).alias("db_key"), F.col("l_orderkey").alias("wal_id"))

    @cached_property
    def src_wal(self) -> DataFrame:
        return self.src_wal_rows.distinct()

    @cached_property
    def retention_policy(self) -> DataFrame:
        """Keep 100 days, except that every sixth database sets no retention."""
        return self.pair.select(
            "db_key", "target",
            F.when(F.col("db_key") % 6 != 4, F.lit(KEEP_SECONDS)).alias("keep_s"),
            F.lit(MIN_AGE_SECONDS).alias("min_age_s"),
        )


# The same views in DuckDB SQL, in dependency order.
SQL: dict[str, str] = {
    "fx_database": """SELECT c_custkey AS db_key, concat('s3://data/tenant', CAST(c_nationkey AS VARCHAR), '/db', CAST(c_custkey AS VARCHAR)) AS db_url, c_nationkey, c_mktsegment FROM customer""",
    "fx_heartbeat": f"""SELECT concat('node-', CAST(user_id AS VARCHAR)) AS node_id, CASE event_type WHEN 'click' THEN 'g' WHEN 'view' THEN 'c' WHEN 'purchase' THEN 'w' WHEN 'signup' THEN 'm' ELSE 'x' END AS letters, concat('nodes/node-', CAST(user_id AS VARCHAR), '.', CASE event_type WHEN 'click' THEN 'g' WHEN 'view' THEN 'c' WHEN 'purchase' THEN 'w' WHEN 'signup' THEN 'm' ELSE 'x' END, '.json') AS location, max(ts) AS last_modified FROM events GROUP BY user_id, event_type""",
    "fx_node": f"""SELECT node_id, letters, location, last_modified, greatest(0, epoch_us(TIMESTAMP '{HEARTBEAT_NOW}') - epoch_us(last_modified)) AS age_us, CASE letters WHEN 'g' THEN 'gc' WHEN 'c' THEN 'compactor-coordinator' WHEN 'w' THEN 'compaction-workers' WHEN 'm' THEN 'mirror' END AS service FROM fx_heartbeat QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY age_us, location) = 1""",
    "fx_live": f"""SELECT * FROM fx_node WHERE age_us < {HEARTBEAT_TIMEOUT}000000""",
    "fx_target": """SELECT concat('t', CAST(n_nationkey AS VARCHAR)) AS target, concat('s3://data/tenant', CAST(n_nationkey AS VARCHAR)) AS source_prefix, CASE WHEN n_nationkey % 7 = 0 THEN 's3://dr/shared' ELSE concat('s3://dr', CAST(n_regionkey AS VARCHAR), '/mirrors/tenant', CAST(n_nationkey AS VARCHAR)) END AS url, n_nationkey % 11 = 0 AS disabled FROM nation""",
    "fx_target_x": """SELECT * FROM fx_target UNION ALL SELECT concat('all', CAST(r_regionkey AS VARCHAR)), NULL, db_url, r_regionkey <> 1 FROM region JOIN fx_database ON db_key = r_regionkey * 25""",
    "fx_target_over": """SELECT c_custkey AS db_key, CASE WHEN c_custkey % 9 <= 3 THEN concat('t', CAST(c_nationkey AS VARCHAR)) ELSE concat('own', CAST(c_custkey % 4 AS VARCHAR)) END AS target, CASE WHEN c_custkey % 9 = 0 THEN concat('gs://own/db', CAST(c_custkey AS VARCHAR)) END AS url, CASE WHEN c_custkey % 9 = 1 THEN true END AS disabled, CASE WHEN c_custkey % 9 = 2 THEN 'periodic' END AS mode, CASE WHEN c_custkey % 9 = 3 THEN c_custkey % 5 END AS copy_parallelism FROM customer""",
    "fx_override": """SELECT c_custkey AS db_key, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 4 + 1 AS BIGINT) END AS workers_count, CASE c_mktsegment WHEN 'MACHINERY' THEN 'gc' WHEN 'HOUSEHOLD' THEN 'gc,compaction-workers' WHEN 'BUILDING' THEN '' END AS services, CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 900 AS DOUBLE) END AS gc_min_age_s FROM customer""",
    "fx_fleet": """SELECT CAST(max(p_size) % 4 + 1 AS BIGINT) AS workers_count, CAST(min(p_size) * 120 AS DOUBLE) AS gc_min_age_s, CAST(max(p_size) + 10 AS DOUBLE) AS poll_s FROM part""",
    "fx_settings": """SELECT o.db_key, coalesce(o.services, 'gc,compactor-coordinator,compaction-workers,mirror') AS services, coalesce(o.workers_count, f.workers_count, 1) AS workers_count, coalesce(o.gc_min_age_s, f.gc_min_age_s, 300) AS gc_min_age_s, coalesce(f.poll_s, 5) AS poll_s FROM fx_override o LEFT JOIN fx_fleet f ON true""",
    "fx_applied": """SELECT d.db_key, d.db_url, t.target, concat(t.url, CASE WHEN t.source_prefix IS NULL THEN '' ELSE substr(d.db_url, length(t.source_prefix) + 1) END) AS destination FROM fx_database d JOIN fx_target_x t ON NOT t.disabled AND (t.source_prefix IS NULL OR d.db_url = t.source_prefix OR starts_with(d.db_url, concat(t.source_prefix, '/'))) WHERE destination <> d.db_url""",
    "fx_manifest": """SELECT o_custkey % 20 AS db_key, o_orderkey AS manifest_id, o_orderdate AS last_modified, o_orderkey AS replay_after_wal_id, o_orderkey + 1 + o_orderkey % 4 AS next_wal_sst_id, o_orderkey AS last_l0_seq FROM orders""",
    "fx_sst": """SELECT DISTINCT o_custkey % 20 AS db_key, o_orderkey AS manifest_id, lpad(CAST(o_orderkey - o_orderkey % 200 + l_linenumber AS VARCHAR), 26, '0') AS ulid FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
    "fx_object": """SELECT db_key, manifest_id, 'compacted' AS kind, concat('compacted/', ulid, '.sst') AS object_name FROM fx_sst UNION ALL SELECT db_key, manifest_id, 'wal', concat('wal/', lpad(CAST(unnest(range(replay_after_wal_id + 1, next_wal_sst_id)) AS VARCHAR), 20, '0'), '.sst') FROM fx_manifest""",
    "fx_checkpoint": """SELECT m.o_custkey % 20 AS db_key, m.o_orderkey AS manifest_id, concat('cp-', CAST(c.o_orderkey AS VARCHAR)) AS cp_id, c.o_orderkey AS pinned_id, c.o_orderdate AS create_time, CASE WHEN c.o_orderstatus = 'O' THEN NULL WHEN c.o_orderstatus = 'P' THEN TIMESTAMP '2030-01-01 00:00:00' ELSE TIMESTAMP '1999-01-01 00:00:00' END AS expire_time FROM orders m JOIN orders c ON m.o_custkey % 20 = c.o_custkey % 20 AND m.o_orderkey > c.o_orderkey AND m.o_orderkey <= c.o_orderkey + 400 WHERE c.o_orderpriority = '1-URGENT'""",
    "fx_wal": """SELECT DISTINCT l_suppkey % 4 AS db_key, l_orderkey AS wal_id FROM lineitem""",
    "fx_compaction": """SELECT l_suppkey AS db_key, CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'Submitted' WHEN 'AO' THEN 'Scheduled' WHEN 'NF' THEN 'Running' WHEN 'NO' THEN 'Compacted' WHEN 'RF' THEN 'Completed' ELSE 'Failed' END AS status FROM lineitem""",
    "fx_seq": """SELECT event_id * 7 + 3 AS seq, ts FROM events""",
    "fx_src_manifest": """SELECT * FROM fx_manifest WHERE db_key <> 5 OR manifest_id < (SELECT max(o_orderkey) FROM orders) - 500""",
    "fx_dst_manifest": f"""SELECT *, '{TARGET}' AS target, manifest_id % 4999 <> 17 AS readable FROM fx_manifest WHERE db_key <> 7 AND (db_key = 3 OR manifest_id < (SELECT max(o_orderkey) FROM orders) - 200)""",
    "fx_src_cp": """SELECT c.* FROM fx_checkpoint c SEMI JOIN fx_src_manifest m USING (db_key, manifest_id)""",
    "fx_dst_cp": """SELECT c.* FROM fx_checkpoint c SEMI JOIN fx_dst_manifest m USING (db_key, manifest_id)""",
    "fx_pair": f"""SELECT DISTINCT db_key, '{TARGET}' AS target, CASE db_key % 3 WHEN 0 THEN 'builtin' WHEN 1 THEN 'external' ELSE 'rclone' END AS copier FROM fx_manifest""",
    "fx_dst_object": f"""SELECT s.db_key AS db_key, 'compacted' AS kind, concat('compacted/', s.ulid, '.sst') AS object_name, CAST(NULL AS BIGINT) AS wal_id, min(m.last_modified) AS last_modified, '{TARGET}' AS target FROM fx_sst s JOIN fx_manifest m ON m.db_key = s.db_key AND m.manifest_id = s.manifest_id WHERE s.db_key <> 7 AND s.manifest_id < (SELECT max(o_orderkey) FROM orders) - 100 AND CAST(s.ulid AS BIGINT) % 7 <> 3 GROUP BY s.db_key, s.ulid UNION ALL SELECT l_suppkey % 20, 'wal', concat('wal/', lpad(CAST(l_orderkey AS VARCHAR), 20, '0'), '.sst'), l_orderkey, min(l_shipdate), '{TARGET}' FROM lineitem WHERE l_suppkey % 20 <> 7 GROUP BY l_suppkey % 20, l_orderkey""",
    "fx_src_wal": """SELECT DISTINCT l_suppkey % 19 AS db_key, l_orderkey AS wal_id FROM lineitem""",
    "fx_policy": f"""SELECT db_key, target, CASE WHEN db_key % 6 <> 4 THEN {KEEP_SECONDS} END AS keep_s, {MIN_AGE_SECONDS} AS min_age_s FROM fx_pair""",
    "fx_src_head": """SELECT db_key, max(manifest_id) AS head FROM fx_src_manifest GROUP BY db_key""",
    "fx_dst_head": """SELECT db_key, target, max(manifest_id) AS watermark FROM fx_dst_manifest GROUP BY db_key, target""",
    "fx_member": f"""SELECT db_key, head, head AS member_id, true AS present FROM fx_src_head UNION ALL SELECT p.db_key, p.head, p.pinned_id, m.manifest_id IS NOT NULL FROM (SELECT DISTINCT h.db_key, h.head, c.pinned_id FROM fx_src_head h JOIN fx_src_cp c ON c.db_key = h.db_key AND c.manifest_id = h.head WHERE (c.expire_time IS NULL OR c.expire_time > TIMESTAMP '{MIRROR_NOW}') AND c.pinned_id <> h.head) p LEFT JOIN fx_src_manifest m ON m.db_key = p.db_key AND m.manifest_id = p.pinned_id""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` as one statement, with the views it needs as common table expressions."""
    import re

    views = {**SQL, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in sorted(set(re.findall(r"\bfx_\w+", text))):
            if name in views and name not in needed:
                visit(views[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({views[name]})" for name in needed)
    return f"WITH {ctes}\n{body}"
