"""Streaming queries, run to the end of the given tables; their final tables are checked."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.catalog.fixtures import HEARTBEAT_TIMEOUT, SQL, TARGET, Fixtures
from quayside.catalog.fleet_queries import PLACEMENT_VIEWS, entries, wanted
from quayside.catalog.mirror_queries import SYNC_VIEWS, TAIL_VIEWS, floors
from quayside.catalog.registration import query
from quayside.functions.names import heartbeat_parts
from quayside.operators import liveness
from quayside.operators.snapshot import Catalog
from quayside.session import settle, shared_dir
from quayside.streaming.leases import lease_periods
from quayside.streaming.handoff import HandoffStream
from quayside.streaming.keyed import run_keyed
from quayside.streaming.liveness import liveness_changes, liveness_periods, to_the_end
from quayside.streaming.mirror import ContinuousMirror, run_available
from quayside.streaming.settings import settings_changes, settings_view
from quayside.streaming.tail import ids_of, tailed_runs
from quayside.streaming.target import side_by_side

LEASE_SECONDS = 6 * 3600
# Where the events are cut into three arrivals.
ARRIVALS = ["2024-01-11 00:00:00", "2024-01-21 00:00:00"]


def streamed(fx: Fixtures, table: str) -> DataFrame:
    """A given table as a stream of its files: one file, or a folder of many."""
    # A pattern, since a stream takes a path without one to be a folder.
    return fx.spark.readStream.schema(fx.table(table).schema).parquet(f"{fx.sf_dir}/{table}.parque[t]")


def to_table(fx: Fixtures, stream: DataFrame, purpose: str) -> DataFrame:
    """Run a stream to its end in append mode; the rows it emitted."""
    path = shared_dir(fx.spark, purpose)
    sink = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out")
    sink.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return fx.spark.read.schema(stream.schema).parquet(f"{path}/out")


def naive(df: DataFrame, *columns: str) -> DataFrame:
    for column in columns:
        df = df.withColumn(column, F.col(column).cast("timestamp_ntz"))
    return df


def in_arrivals(fx: Fixtures, rows: DataFrame, purpose: str, arrivals: int, each: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Feed rows by their number of ``arrival``; the stream restarts from its checkpoint for each. What it emitted."""
    path = shared_dir(fx.spark, purpose)
    fed = rows.drop("arrival")
    for number in range(arrivals):
        rows.filter(F.col("arrival") == number).drop("arrival").write.mode("append").parquet(f"{path}/in")
        stream = each(fx.spark.readStream.schema(fed.schema).parquet(f"{path}/in"))
        out = run_keyed(stream, f"{path}/out", f"{path}/checkpoint")
    return out


def arrival_of(ts: str):
    """In which of the three arrivals a time falls."""
    return sum((F.col(ts) >= F.lit(cut).cast("timestamp_ntz")).cast("int") for cut in ARRIVALS)


def sessions_sql(source: str, key: str, gap_us: int) -> str:
    return f"""SELECT {key}, min(ts) AS start_ts, max(ts) AS last_ts, count(*) AS n, max_by(event_type, ts) AS last_type FROM
      (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM
        (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY {key} ORDER BY ts)) < {gap_us} THEN 0 ELSE 1 END AS fresh FROM {source})) GROUP BY {key}, part"""


NODE_SERVICE = "CASE last_type WHEN 'click' THEN 'gc' WHEN 'view' THEN 'compactor-coordinator' WHEN 'purchase' THEN 'compaction-workers' WHEN 'signup' THEN 'mirror' ELSE '' END"
NEWEST = "SELECT epoch_us(max(ts)) FROM events"


def end_sql(seconds: int) -> str:
    return f"CASE WHEN epoch_us(last_ts) + {seconds}000000 <= ({NEWEST}) THEN make_timestamp(epoch_us(last_ts) + {seconds}000000) END"


@query(
    "sm1_liveness_periods",
    f"""SELECT concat('node-', CAST(user_id AS VARCHAR)) AS node_id, start_ts AS up_at, {end_sql(HEARTBEAT_TIMEOUT)} AS down_at, n AS heartbeats, {NODE_SERVICE} AS services FROM fx_session""",
    {"fx_session": sessions_sql("events", "user_id", HEARTBEAT_TIMEOUT * 1_000_000)},
)
def sm1_periods(fx: Fixtures) -> DataFrame:
    """Periods of liveness: those that ended, from the stream, and those still open."""
    def named(events: DataFrame) -> DataFrame:
        services = heartbeat_parts(F.element_at(F.split("path", "/"), -1))["services"]
        return fx.heartbeat_rows(events).select("node_id", "ts", services.alias("services"))

    def periods(rows: DataFrame) -> DataFrame:
        return liveness_periods(rows, HEARTBEAT_TIMEOUT)

    ended = to_table(fx, periods(named(streamed(fx, "events"))), "liveness-periods")
    out = to_the_end(ended, named(fx.table("events")), "node_id", "down_at", periods)
    return naive(out, "up_at", "down_at").withColumn("services", F.array_join("services", ","))


# How late a heartbeat may be known, in days: more than the arrivals are apart.
LATE_DAYS = 11
TICK_VIEWS = {
    "fx_beat": f"""SELECT user_id, ts, {NODE_SERVICE.replace('last_type', 'event_type')} AS services, event_id % 13 = 0 AS deleted,
      CAST(ts >= TIMESTAMP '{ARRIVALS[0]}' AS INTEGER) + CAST(ts >= TIMESTAMP '{ARRIVALS[1]}' AS INTEGER) + CAST(event_id % 7 = 3 AS INTEGER) AS arrival FROM events""",
    "fx_known": "SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY arrival RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS youngest FROM fx_beat",
    "fx_taken": f"""SELECT *, coalesce(NOT was_deleted AND epoch_us(ts) - epoch_us(was) < {HEARTBEAT_TIMEOUT}000000, false) AS was_live FROM
      (SELECT *, lag(ts) OVER w AS was, lag(deleted) OVER w AS was_deleted, lag(services) OVER w AS old_services, lead(ts) OVER w AS next FROM fx_known
       WHERE youngest IS NULL OR ts > youngest WINDOW w AS (PARTITION BY user_id ORDER BY ts, deleted, services))""",
}


@query(
    "sm1_liveness_ticks",
    f"""SELECT concat('node-', CAST(user_id AS VARCHAR)) AS node_id, change, changed AS at, services FROM
      (SELECT user_id, CASE WHEN was_live THEN 'role' ELSE 'up' END AS change, ts AS changed, services FROM fx_taken WHERE NOT deleted AND (NOT was_live OR services <> old_services)
       UNION ALL SELECT user_id, 'down', ts, old_services FROM fx_taken WHERE deleted AND was_live
       UNION ALL SELECT user_id, 'down', make_timestamp(epoch_us(ts) + {HEARTBEAT_TIMEOUT}000000), services FROM fx_taken
         WHERE NOT deleted AND (next IS NULL OR epoch_us(next) - epoch_us(ts) >= {HEARTBEAT_TIMEOUT}000000))""",
    TICK_VIEWS,
)
def sm1_ticks(fx: Fixtures) -> DataFrame:
    """Up, down and role changes; some heartbeats are known late, some nodes leave, and the last ones just fall silent.

    The last arrival has no heartbeat: only the clock moves on.
    """
    events = fx.table("events")
    parts = heartbeat_parts(F.element_at(F.split("path", "/"), -1))
    beats = fx.heartbeat_rows(events, "event_id").select(
        "node_id", parts["services"].alias("services"), F.col("ts").alias("last_modified"), F.col("path").alias("location"),
        (F.col("event_id") % 13 == 0).alias("deleted"), (arrival_of("ts") + (F.col("event_id") % 7 == 3).cast("int")).alias("arrival"),
    )
    end = F.max("ts") + F.expr(f"INTERVAL {LATE_DAYS} DAYS") + F.expr(f"INTERVAL {HEARTBEAT_TIMEOUT + 1} SECONDS")
    clock = events.agg(end.alias("last_modified")).select(
        F.lit("").alias("node_id"), F.array().cast("array<string>").alias("services"), "last_modified", F.lit("").alias("location"),
        F.lit(False).alias("deleted"), F.lit(len(ARRIVALS) + 2).alias("arrival"),
    )

    def changes(stream: DataFrame) -> DataFrame:
        return liveness_changes(stream, HEARTBEAT_TIMEOUT, f"{LATE_DAYS} days")

    out = in_arrivals(fx, beats.unionByName(clock), "liveness-changes", len(ARRIVALS) + 3, changes)
    return naive(out, "at").withColumn("services", F.array_join("services", ","))


@query("sm2_log_tail", f"SELECT db_key, '{TARGET}' AS target, wal_id FROM fx_run", TAIL_VIEWS)
def sm2(fx: Fixtures) -> DataFrame:
    """WAL ids tailed from each floor, arriving out of order over several batches."""
    path = shared_dir(fx.spark, "log-tail")
    target = F.lit(TARGET).alias("target")
    wal = fx.wal.select("db_key", target, "wal_id")
    starts = floors(fx).select("db_key", target, "floor")
    # Hashing the ids to files makes each batch hold every n-th id at random.
    wal.repartition(4, "wal_id").write.parquet(f"{path}/in")
    starts.write.parquet(f"{path}/floors")
    ids = fx.spark.readStream.schema(wal.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    stream = tailed_runs(ids, fx.spark.readStream.schema(starts.schema).parquet(f"{path}/floors"))
    return ids_of(run_keyed(stream, f"{path}/out", f"{path}/checkpoint"))


@query(
    "sm3_settings_stream",
    """SELECT CAST(user_id AS VARCHAR) AS key, max(event_id) AS latest_version, max(event_id) FILTER (WHERE value >= 5) AS used_version, max_by(event_type, event_id) FILTER (WHERE value >= 5) AS payload, used_version IS NULL AS disabled,
      CASE WHEN used_version IS NULL THEN 'no valid settings yet, so the database is off' WHEN used_version < latest_version THEN 'newest settings invalid, an older version is in force' END AS warning FROM events GROUP BY user_id""",
)
def sm3_stream(fx: Fixtures) -> DataFrame:
    """Last-good settings kept over three arrivals of versions."""
    versions = fx.table("events").select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("version"),
        (F.col("value") >= 5).alias("valid"), F.col("event_type").alias("payload"), arrival_of("ts").alias("arrival"),
    )
    return settings_view(in_arrivals(fx, versions, "settings-arrivals", len(ARRIVALS) + 1, settings_changes))


# How far from the end the source's manifests are cut into three arrivals.
NEWS_CUTS = (120, 60, 0)


def _step_views() -> dict[str, str]:
    """The views of a sync for each arrival: its heads, and the target as the arrivals before have left it."""
    views = {"fx_at_0": "SELECT db_key, target, manifest_id FROM fx_dst_manifest"}
    names = ["fx_src_head", "fx_dst_head", "fx_member", "fx_state", "fx_broken", "fx_ready", "fx_both", "fx_shared_member", "fx_commit", "fx_dst_cp"]
    for step, cut in enumerate(NEWS_CUTS):
        own = {name: SYNC_VIEWS.get(name, SQL.get(name)) for name in names}
        own["fx_src_head"] = f"SELECT db_key, max(manifest_id) AS head FROM fx_src_manifest WHERE manifest_id <= (SELECT max(o_orderkey) FROM orders) - {cut} GROUP BY db_key"
        own["fx_dst_head"] = f"SELECT db_key, target, max(manifest_id) AS watermark FROM fx_at_{step} GROUP BY ALL"
        own["fx_dst_cp"] = f"SELECT c.* FROM fx_checkpoint c SEMI JOIN fx_at_{step} m USING (db_key, manifest_id)"
        own["fx_commit"] += f" AND NOT EXISTS (SELECT 1 FROM fx_at_{step} t WHERE t.db_key = r.db_key AND t.manifest_id = m.member_id)"
        for name, sql in own.items():
            for other in names:
                sql = re.sub(rf"\b{other}\b", f"{other}_{step}", sql)
            views[f"{name}_{step}"] = sql
        views[f"fx_at_{step + 1}"] = f"SELECT * FROM fx_at_{step} UNION ALL SELECT * FROM fx_commit_{step}"
    return views


@query(
    "sm4_continuous_mirror",
    " UNION ALL ".join(
        f"SELECT {step} AS micro_batch, *, row_number() OVER (PARTITION BY db_key, target ORDER BY manifest_id) AS commit_seq FROM fx_commit_{step}"
        for step in range(len(NEWS_CUTS))
    ),
    {**SYNC_VIEWS, **_step_views()},
)
def sm4(fx: Fixtures) -> DataFrame:
    """Commits as source manifests stream in, in three arrivals, each followed by its prune and tail; nothing twice."""
    path = shared_dir(fx.spark, "continuous-mirror")
    tables = [df for side in (fx.source, fx.dest) for df in (side.manifests, side.objects, side.checkpoints)]
    *tables, listing = side_by_side([partial(settle, df, "mirror-tables") for df in (*tables, fx.dst_object)])
    job = ContinuousMirror(
        fx.spark, path, Catalog(*tables[:3]), Catalog(*tables[3:]), listing, fx.pair, fx.mirror_now, fx.retention_policy, fx.src_wal_rows,
        fold_batches=2,
    )
    news = fx.src_manifest.select("db_key", "manifest_id")
    top = fx._top_order()
    arrival = sum((F.col("manifest_id") > top - cut).cast("int") for cut in NEWS_CUTS[:-1])
    for number in range(len(NEWS_CUTS)):
        news.filter(arrival == number).write.mode("append").parquet(f"{path}/in")
        run_available(fx.spark.readStream.schema(news.schema).parquet(f"{path}/in"), job, f"{path}/checkpoint")
    return job.log("commits")


@query(
    "sm6_lease_periods",
    f"""SELECT user_id AS pin_id, start_ts AS held_from, {end_sql(LEASE_SECONDS)} AS lapses_at, n AS refreshes FROM fx_session""",
    {"fx_session": sessions_sql("events", "user_id", LEASE_SECONDS * 1_000_000)},
)
def sm6(fx: Fixtures) -> DataFrame:
    """Stretches over which each pin was kept alive, with events as refreshes."""
    def refreshes(events: DataFrame) -> DataFrame:
        return events.select(F.col("user_id").alias("pin_id"), "ts")

    def periods(rows: DataFrame) -> DataFrame:
        return lease_periods(rows, LEASE_SECONDS)

    lapsed = to_table(fx, periods(refreshes(streamed(fx, "events"))), "leases")
    out = to_the_end(lapsed, refreshes(fx.table("events")), "pin_id", "lapses_at", periods)
    return naive(out, "held_from", "lapses_at")


# Which nodes are live in each of three views, by how many microseconds their heartbeat is old.
FLEET_VIEWS = ("age_us < 18000000000", f"age_us < {HEARTBEAT_TIMEOUT}000000", "age_us >= 3600000000 AND age_us < 50000000000")


def _handoff_sql() -> str:
    seen = ", ".join(f"{view} AS live{n}" for n, view in enumerate(FLEET_VIEWS))
    ranks = ", ".join(
        f"live{n} AND row_number() OVER (PARTITION BY db_url, service, target ORDER BY NOT live{n}, score DESC, node_id) <= k AS own{n}" for n in range(len(FLEET_VIEWS))
    )
    owned = f"(SELECT *, {ranks} FROM (SELECT s.*, {seen} FROM fx_scored s JOIN fx_node n USING (node_id)))"
    return " UNION ALL ".join(
        f"""SELECT {n} AS micro_batch, db_url, service, target, string_agg(node_id, ',' ORDER BY node_id) FILTER (WHERE {was}) AS lost, string_agg(node_id, ',' ORDER BY node_id) FILTER (WHERE own{n}) AS gained
        FROM {owned} WHERE {was} <> own{n} GROUP BY ALL""" for n, was in ((n, f"own{n - 1}" if n else "false") for n in range(len(FLEET_VIEWS)))
    )


@query("sm8_handoff_stream", _handoff_sql(), PLACEMENT_VIEWS)
def sm8_stream(fx: Fixtures) -> DataFrame:
    """Handoffs over three views of the fleet, the first of which finds nobody in charge."""
    nodes = settle(
        liveness.youngest_per_node(entries(fx)).select("node_id", "services", F.col("age_micros").alias("age_us")), "fleet"
    )
    job = HandoffStream(fx.spark, shared_dir(fx.spark, "handoffs"), settle(wanted(fx), "assignments"), full_every=2)
    was = F.lit(False)
    for number, view in enumerate(FLEET_VIEWS):
        now = F.expr(view)
        change = F.when(now & ~was, "up").when(~now & was, "down")
        job(nodes.select("node_id", change.alias("change"), F.lit(number).alias("at"), "services").filter("change IS NOT NULL"), number)
        was = now
    text = {c: F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c) for c in ("lost", "gained")}
    return job.events().select("micro_batch", "db_url", "service", "target", text["lost"], text["gained"])
