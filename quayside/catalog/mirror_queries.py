"""Queries over snapshot catalogs: closures, sync, retention, restore, lag, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.catalog.fixtures import KEEP_SECONDS, MIN_AGE_SECONDS, MIRROR_NOW, TARGET, Fixtures
from quayside.catalog.registration import query
from quayside.operators import intervals, liveness, ordered, sets, snapshot
from quayside.plans import audits, lag, mirror, restore, retention
from quayside.session import settle, shared_dir
from quayside.sinks import commit, conditional, objects, responses
from quayside.sources import documents, jobs, listings

PAIR = ["db_key", "target"]
LIVE = f"(expire_time IS NULL OR expire_time > TIMESTAMP '{MIRROR_NOW}')"


def runs_sql(ids: str, keys: str, number: str = "wal_id") -> str:
    """The fewest runs of distinct ids: those whose distance to their rank is the same."""
    return f"""SELECT {keys}, min({number}) AS "start", max({number}) + 1 AS "end"
      FROM (SELECT *, {number} - row_number() OVER (PARTITION BY {keys} ORDER BY {number}) AS island FROM ({ids})) GROUP BY {keys}, island"""


# ------------------------------------------------------- snapshot listings

LISTING_VIEW = {
    "fx_listed": """SELECT DISTINCT l_suppkey % 20 AS db_key, CASE l_linenumber % 4 WHEN 0 THEN concat('manifest/', lpad(CAST(l_orderkey AS VARCHAR), 20, '0'), '.manifest')
      WHEN 1 THEN concat('wal/', lpad(CAST(l_orderkey AS VARCHAR), 20, '0'), '.sst') WHEN 2 THEN concat('compacted/', lpad(CAST(l_orderkey AS VARCHAR), 26, '0'), '.sst') ELSE concat('wal/', CAST(l_orderkey AS VARCHAR), '.tmp') END AS path FROM lineitem""",
}


@query(
    "src6_snapshot_listings",
    """SELECT db_key, split_part(path, '/', 1) AS kind, count(*) AS n, min(path) AS first_path, max(path) AS last_path FROM fx_listed WHERE path NOT LIKE '%.tmp' GROUP BY ALL""",
    LISTING_VIEW,
)
def src6(fx: Fixtures) -> DataFrame:
    """Manifests, WALs and compacted objects in one listing; other names skipped."""
    key, way = F.col("l_orderkey").cast("string"), F.col("l_linenumber") % 4
    path = (
        F.when(way == 0, F.concat(F.lit("manifest/"), F.lpad(key, 20, "0"), F.lit(".manifest")))
        .when(way == 1, F.concat(F.lit("wal/"), F.lpad(key, 20, "0"), F.lit(".sst")))
        .when(way == 2, F.concat(F.lit("compacted/"), F.lpad(key, 26, "0"), F.lit(".sst")))
        .otherwise(F.concat(F.lit("wal/"), key, F.lit(".tmp")))
    )
    listing = fx.table("lineitem").select((F.col("l_suppkey") % 20).alias("db_key"), path.alias("path")).distinct()
    return listings.snapshot_listings(listing).groupBy("db_key", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"), F.max("path").alias("last_path")
    )


def _views_sql(count: str, offset: int) -> str:
    return f"list_transform(range(1, {count} + 1), lambda i: o_orderkey - o_orderkey % 50 + {offset} + i)"


NESTED_VIEW = {
    "fx_nested": f"""SELECT DISTINCT db_key, manifest_id, CASE WHEN n % 13 = 0 THEN 'wal' ELSE 'compacted' END AS kind,
        CASE WHEN n % 13 = 0 THEN concat('wal/', lpad(CAST(n AS VARCHAR), 20, '0'), '.sst') ELSE concat('compacted/', lpad(CAST(n AS VARCHAR), 26, '0'), '.sst') END AS object_name
      FROM (SELECT o_custkey % 20 AS db_key, o_orderkey AS manifest_id, unnest(list_concat(list_concat(list_concat({_views_sql('o_orderkey % 3', 0)}, {_views_sql('2', 1)}), {_views_sql('o_orderkey % 4', 5)}), list_concat({_views_sql('o_orderkey % 2', 20)}, {_views_sql('o_orderkey % 5', 21)}))) AS n FROM orders)
      UNION SELECT db_key, manifest_id, 'wal', concat('wal/', lpad(CAST(unnest(range(replay_after_wal_id + 1, next_wal_sst_id)) AS VARCHAR), 20, '0'), '.sst') FROM fx_manifest""",
}


@query("src7_manifest_objects", "SELECT * FROM fx_nested", NESTED_VIEW)
def src7(fx: Fixtures) -> DataFrame:
    """Objects each nested manifest references."""
    return snapshot.manifest_objects(fx.nested_manifest)


@query("st2_range_expansion", "SELECT db_key, manifest_id, object_name FROM fx_object WHERE kind = 'wal'")
def st2(fx: Fixtures) -> DataFrame:
    """WAL windows expanded to ids; empty windows give nothing."""
    return snapshot.window_objects(fx.manifest).select("db_key", "manifest_id", "object_name")


QUEUE = """SELECT c.s_suppkey AS db_key, count(*) FILTER (WHERE status IN ('Submitted', 'Scheduled')) AS claimable, count(*) FILTER (WHERE status = 'Running') AS running FROM supplier c LEFT JOIN fx_compaction j ON j.db_key = c.s_suppkey GROUP BY c.s_suppkey"""


@query("src8_compaction_statuses", "SELECT db_key, status, count(*) AS n FROM fx_compaction GROUP BY db_key, status")
def src8(fx: Fixtures) -> DataFrame:
    """Compaction jobs by status."""
    return fx.compaction.groupBy("db_key", "status").agg(F.count(F.lit(1)).alias("n"))


@query("ag3_queue_depth", QUEUE)
def ag3(fx: Fixtures) -> DataFrame:
    """Claimable and running compactions per database, zero if it has none."""
    databases = fx.table("supplier").select(F.col("s_suppkey").alias("db_key"))
    return jobs.queue_depth(databases, fx.compaction)


# ------------------------------------------------------------ closures


@query(
    "ag2_watermarks",
    """SELECT p.db_key, p.target, s.head, d.watermark, CASE WHEN s.head IS NULL THEN 'no manifests at the source' WHEN d.watermark > s.head THEN 'diverged' WHEN d.watermark = s.head THEN 'caught up' END AS state
    FROM fx_pair p LEFT JOIN fx_src_head s USING (db_key) LEFT JOIN fx_dst_head d USING (db_key)""",
)
def ag2(fx: Fixtures) -> DataFrame:
    """Head and watermark of every pair."""
    states = mirror.pair_states(fx.src_manifest, fx.dst_manifest, fx.pair)
    return states.select(*PAIR, "head", "watermark", "state")


@query(
    "so2_latest_manifest",
    "SELECT db_key, max(manifest_id) AS manifest_id, max_by(last_modified, manifest_id) AS last_modified FROM fx_manifest GROUP BY db_key",
)
def so2(fx: Fixtures) -> DataFrame:
    """The latest manifest of every database with its time."""
    return snapshot.heads(fx.manifest).select("db_key", "manifest_id", "last_modified")


@query("jn5_closure_members", "SELECT * FROM fx_member")
def jn5(fx: Fixtures) -> DataFrame:
    """Closure of every source head."""
    roots = snapshot.heads(fx.source.manifests).select("db_key", "manifest_id")
    return snapshot.closure_members(fx.source, roots, fx.mirror_now)


CLOSURE_VIEW = {
    "fx_closure": "SELECT DISTINCT m.db_key, m.head, o.kind, o.object_name FROM fx_member m JOIN fx_object o ON o.db_key = m.db_key AND o.manifest_id = m.member_id WHERE m.present",
}


@query("ag5_closure_union", "SELECT * FROM fx_closure", CLOSURE_VIEW)
def ag5(fx: Fixtures) -> DataFrame:
    """Distinct objects of every head's closure."""
    roots = snapshot.heads(fx.source.manifests).select("db_key", "manifest_id")
    members = snapshot.closure_members(fx.source, roots, fx.mirror_now).filter("present")
    return snapshot.closure_objects(members, fx.source.objects)


CLOSURE_IDS = "SELECT DISTINCT m.db_key, m.head, unnest(range(x.replay_after_wal_id + 1, x.next_wal_sst_id)) AS wal_id FROM fx_member m JOIN fx_src_manifest x ON x.db_key = m.db_key AND x.manifest_id = m.member_id WHERE m.present"


@query("ag5_closure_wal_runs", runs_sql(CLOSURE_IDS, "db_key, head"))
def ag5_runs(fx: Fixtures) -> DataFrame:
    """The WAL ids of every head's closure, as runs."""
    roots = snapshot.heads(fx.source.manifests).select("db_key", "manifest_id")
    members = snapshot.closure_members(fx.source, roots, fx.mirror_now).filter("present")
    return snapshot.closure_runs(members, fx.source.manifests)


@query(
    "ag12_object_counts",
    "SELECT db_key, manifest_id, count(*) FILTER (WHERE kind = 'wal') AS n_wal, count(*) FILTER (WHERE kind = 'compacted') AS n_compacted, count(*) AS n_objects FROM fx_nested GROUP BY db_key, manifest_id",
    NESTED_VIEW,
)
def ag12(fx: Fixtures) -> DataFrame:
    """Object counts of every manifest."""
    return snapshot.object_counts(snapshot.manifest_objects(fx.nested_manifest), ["db_key", "manifest_id"])


@query(
    "st1_object_set_algebra",
    """SELECT 'difference' AS op, db_key, object_name FROM (SELECT DISTINCT db_key, kind, object_name FROM fx_object EXCEPT SELECT db_key, kind, object_name FROM fx_dst_object)
    UNION ALL SELECT 'union', db_key, object_name FROM (SELECT db_key, kind, object_name FROM fx_object UNION SELECT db_key, kind, object_name FROM fx_dst_object)""",
)
def st1(fx: Fixtures) -> DataFrame:
    """Difference and union of referenced and listed objects."""
    on = ["db_key", "kind", "object_name"]
    referenced = settle(fx._objects(fx.manifest, ["db_key"]).select(*on), "referenced")
    listed = settle(fx.dst_object.select(*on), "listed")
    parts = {"difference": sets.difference(referenced, listed, on), "union": sets.union(referenced, listed, on)}
    rows = [df.select(F.lit(op).alias("op"), "db_key", "object_name") for op, df in parts.items()]
    return rows[0].unionByName(rows[1])


RUN_VIEWS = {
    "fx_window_id": "SELECT DISTINCT db_key, unnest(range(replay_after_wal_id + 1, next_wal_sst_id)) AS wal_id FROM fx_manifest",
    "fx_listed_id": "SELECT DISTINCT db_key, wal_id FROM fx_dst_object WHERE wal_id IS NOT NULL",
}
RUN_OPS = {"difference": "EXCEPT", "intersection": "INTERSECT", "union": "UNION"}


@query(
    "st1_run_algebra",
    " UNION ALL ".join(
        f"""SELECT '{op}' AS op, * FROM ({runs_sql(f"SELECT * FROM fx_window_id {word} SELECT * FROM fx_listed_id", "db_key")})"""
        for op, word in RUN_OPS.items()
    ),
    RUN_VIEWS,
)
def st1_runs(fx: Fixtures) -> DataFrame:
    """Windows of all manifests against the WAL ids that the target lists, as runs."""
    windows, listed = snapshot.window_runs(fx.manifest), intervals.as_runs(fx.dst_object, ["db_key"], "wal_id")
    return intervals.algebra(windows, listed, ["db_key"], list(RUN_OPS))


@query(
    "st2_window_sizes",
    "SELECT db_key, count(*) AS n_ids FROM fx_window_id GROUP BY db_key",
    RUN_VIEWS,
)
def st2_sizes(fx: Fixtures) -> DataFrame:
    """How many WAL ids each database's windows hold, without expanding them."""
    return intervals.sizes(snapshot.window_runs(fx.manifest), ["db_key"])


# ---------------------------------------------------------------- sync

SYNC_VIEWS = {
    **CLOSURE_VIEW,
    "fx_state": """SELECT p.db_key, p.target, p.copier, s.head, d.watermark, CASE WHEN s.head IS NULL THEN 'no manifests at the source' WHEN d.watermark > s.head THEN 'diverged' WHEN d.watermark = s.head THEN 'caught up' END AS state
      FROM fx_pair p LEFT JOIN fx_src_head s USING (db_key) LEFT JOIN fx_dst_head d USING (db_key)""",
    "fx_broken": "SELECT DISTINCT m.db_key FROM fx_member m JOIN fx_state s USING (db_key) WHERE NOT m.present AND s.state IS NULL",
    "fx_ready": "SELECT * FROM fx_state WHERE state IS NULL AND db_key NOT IN (SELECT db_key FROM fx_broken)",
    "fx_both": f"""SELECT DISTINCT r.db_key, r.target, w.cp_id, w.pinned_id FROM fx_ready r JOIN fx_dst_cp w ON w.db_key = r.db_key AND w.manifest_id = r.watermark
      JOIN fx_src_cp l ON l.db_key = r.db_key AND l.manifest_id = r.head AND l.cp_id = w.cp_id WHERE (w.expire_time IS NULL OR w.expire_time > TIMESTAMP '{MIRROR_NOW}') AND (l.expire_time IS NULL OR l.expire_time > TIMESTAMP '{MIRROR_NOW}')""",
    "fx_shared_member": "SELECT DISTINCT b.db_key, b.target, b.pinned_id AS member_id FROM fx_both b JOIN fx_member m ON m.db_key = b.db_key AND m.member_id = b.pinned_id",
    "fx_own": "SELECT r.db_key, r.target, o.kind, o.object_name FROM fx_ready r JOIN fx_object o ON o.db_key = r.db_key AND o.manifest_id = r.watermark",
    "fx_proven": "SELECT * FROM fx_own UNION SELECT s.db_key, s.target, o.kind, o.object_name FROM fx_shared_member s JOIN fx_object o ON o.db_key = s.db_key AND o.manifest_id = s.member_id",
    "fx_candidate": "SELECT r.db_key, r.target, r.copier, c.kind, c.object_name FROM fx_ready r JOIN fx_closure c USING (db_key) WHERE NOT EXISTS (SELECT 1 FROM fx_proven p WHERE p.db_key = r.db_key AND p.target = r.target AND p.object_name = c.object_name)",
    "fx_copy": "SELECT db_key, target, kind, object_name FROM fx_candidate c WHERE NOT ((kind = 'wal' OR copier = 'external') AND EXISTS (SELECT 1 FROM fx_dst_object d WHERE d.db_key = c.db_key AND d.object_name = c.object_name))",
    "fx_commit": """SELECT r.db_key, r.target, m.member_id AS manifest_id FROM fx_ready r JOIN fx_member m USING (db_key) WHERE r.watermark IS DISTINCT FROM m.member_id AND NOT EXISTS (SELECT 1 FROM fx_shared_member s WHERE s.db_key = r.db_key AND s.member_id = m.member_id)""",
    "fx_class": """SELECT s.db_key, s.target, CASE WHEN state IS NOT NULL THEN state WHEN s.db_key IN (SELECT db_key FROM fx_broken) THEN 'restart' WHEN s.db_key IN (SELECT db_key FROM fx_copy) THEN 'copy and commit' ELSE 'commit only' END AS class, state IS NULL AND watermark IS NULL AS seeding, head, watermark FROM fx_state s""",
}


def sync(fx: Fixtures) -> mirror.SyncPlan:
    return mirror.sync_plan(fx.source, fx.dest, fx.dst_object, fx.pair, fx.mirror_now)


def ready_parts(fx: Fixtures):
    """Pairs with work, and the closures of their source heads."""
    states = mirror.pair_states(fx.src_manifest, fx.dst_manifest, fx.pair)
    pending = states.filter(F.col("state").isNull())
    roots = pending.select("db_key", F.col("head").alias("manifest_id")).distinct()
    members = snapshot.closure_members(fx.source, roots, fx.mirror_now)
    broken = members.filter(~F.col("present")).select("db_key").distinct()
    return pending.join(broken, "db_key", "left_anti"), members.join(broken, "db_key", "left_anti")


@query("jb2_sync_classes", "SELECT * FROM fx_class", SYNC_VIEWS)
def jb2_classes(fx: Fixtures) -> DataFrame:
    """What each pair's pass amounts to."""
    return sync(fx).pairs.drop("next_wal_sst_id")


@query("jb2_copy_rows", "SELECT * FROM fx_copy", SYNC_VIEWS)
def jb2_copies(fx: Fixtures) -> DataFrame:
    """Objects each pass copies."""
    return sync(fx).copies


COPY_IDS = "SELECT db_key, target, CAST(substr(object_name, 5, 20) AS BIGINT) AS wal_id FROM fx_copy WHERE kind = 'wal'"


@query("jb2_wal_runs", runs_sql(COPY_IDS, "db_key, target"), SYNC_VIEWS)
def jb2_runs(fx: Fixtures) -> DataFrame:
    """The WAL ids each pass copies, as runs."""
    ready, members = ready_parts(fx)
    ready, members = settle(ready, "ready"), settle(members, "members")
    present = mirror.present_manifests(fx.source, fx.dest, ready, members, fx.mirror_now)
    return mirror.wal_runs_to_copy(fx.src_manifest, fx.dst_object, ready, members, present)


@query(
    "so1_commit_order",
    "SELECT *, row_number() OVER (PARTITION BY db_key, target ORDER BY manifest_id) AS commit_seq FROM fx_commit",
    SYNC_VIEWS,
)
def so1(fx: Fixtures) -> DataFrame:
    """Manifests each pass commits, in order."""
    return sync(fx).commits


@query(
    "jn6_incremental_diff",
    "SELECT c.db_key, c.kind, c.object_name FROM fx_closure c JOIN fx_ready r USING (db_key) WHERE NOT EXISTS (SELECT 1 FROM fx_own o WHERE o.db_key = c.db_key AND o.object_name = c.object_name)",
    SYNC_VIEWS,
)
def jn6(fx: Fixtures) -> DataFrame:
    """Closure objects the watermark does not reference."""
    ready, members = ready_parts(fx)
    marks = ready.select(*PAIR, F.col("watermark").alias("manifest_id"))
    own = fx.dest.objects.join(marks, [*PAIR, "manifest_id"])
    wanted = snapshot.closure_objects(members, fx.source.objects).join(ready.select("db_key"), "db_key")
    return sets.difference(settle(wanted, "wanted"), settle(own, "own"), ["db_key", "kind", "object_name"])


@query("jn7_live_in_both", "SELECT db_key, target, manifest_id FROM (SELECT db_key, target, member_id AS manifest_id FROM fx_shared_member UNION SELECT db_key, target, watermark FROM fx_ready WHERE watermark IS NOT NULL)", SYNC_VIEWS)
def jn7(fx: Fixtures) -> DataFrame:
    """Manifests known to be at the target: the watermark and shared live pins."""
    ready, members = ready_parts(fx)
    return mirror.present_manifests(fx.source, fx.dest, ready, members, fx.mirror_now)


@query(
    "jn8_presence_check",
    "SELECT p.db_key, p.target, o.kind, o.object_name FROM fx_pair p JOIN (SELECT DISTINCT db_key, kind, object_name FROM fx_object) o USING (db_key) WHERE NOT ((o.kind = 'wal' OR p.copier = 'external') AND EXISTS (SELECT 1 FROM fx_dst_object d WHERE d.db_key = p.db_key AND d.object_name = o.object_name))",
)
def jn8(fx: Fixtures) -> DataFrame:
    """What each copier would still move if every object were a candidate."""
    every = fx._objects(fx.manifest, ["db_key"]).select("db_key", "kind", "object_name").distinct()
    candidates = every.join(fx.pair, "db_key")
    return mirror.missing_at_target(candidates, fx.dst_object).select(*PAIR, "kind", "object_name")


SIZE = "CAST(regexp_extract(object_name, '([0-9]+)\\.sst$', 1) AS BIGINT) % 4096 + 1"


def sizes(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "size", F.regexp_extract("object_name", r"([0-9]+)\.sst$", 1).cast("bigint") % 4096 + 1
    )


@query(
    "ag9_copied_totals",
    f"SELECT db_key, target, count(*) AS objects, CAST(sum({SIZE}) AS BIGINT) AS bytes FROM fx_copy GROUP BY db_key, target",
    SYNC_VIEWS,
)
def ag9(fx: Fixtures) -> DataFrame:
    """Objects and bytes each pass copies."""
    return sizes(sync(fx).copies).groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes")
    )


@query("snk5_copy_list", "SELECT DISTINCT object_name FROM fx_copy", SYNC_VIEWS)
def snk5(fx: Fixtures) -> DataFrame:
    """The copy list as written for an outside copier, read back."""
    path = shared_dir(fx.spark, "copy-list")
    objects.export_copy_list(sync(fx).copies, path)
    return fx.spark.read.text(path).withColumnRenamed("value", "object_name")


@query(
    "snk2_commit_classes",
    """SELECT m.db_key, m.manifest_id, CASE WHEN d.manifest_id IS NULL THEN 'insert' WHEN m.manifest_id % 1499 = 5 THEN 'diverged' ELSE 'same' END AS class, row_number() OVER (PARTITION BY m.db_key ORDER BY m.manifest_id) AS commit_seq FROM fx_src_manifest m LEFT JOIN fx_dst_manifest d ON d.db_key = m.db_key AND d.manifest_id = m.manifest_id""",
)
def snk2(fx: Fixtures) -> DataFrame:
    """Every source manifest against what its target holds under that id."""
    content = F.concat_ws("|", "manifest_id", "last_l0_seq", "next_wal_sst_id")
    source = fx.src_manifest.withColumn("content", content)
    forked = F.when(F.col("manifest_id") % 1499 == 5, F.lit("|forked")).otherwise(F.lit(""))
    target = fx.dst_manifest.withColumn("content", F.concat(content, forked))
    return commit.commit_classes(source, target, ["db_key"], "manifest_id")


@query(
    "snk3_plan_totals",
    """SELECT page_id % 20 AS db_key, concat('t', CAST(page_id % 3 AS VARCHAR)) AS target, count(*) FILTER (WHERE page_id % 50 <> 7) AS objects,
      CAST(coalesce(sum(strlen(html)) FILTER (WHERE page_id % 50 <> 7), 0) AS BIGINT) AS bytes, count(*) FILTER (WHERE page_id % 50 = 7) AS failed FROM pages GROUP BY ALL""",
)
def snk3_plan(fx: Fixtures) -> DataFrame:
    """A plan of many pairs carried out, each target with its own parallelism; some objects are gone at the source."""
    root = shared_dir(fx.spark, "objects")
    pages = fx.table("pages").select(
        (F.col("page_id") % 20).alias("db_key"), F.concat(F.lit("t"), (F.col("page_id") % 3).cast("string")).alias("target"),
        (F.col("page_id") % 3 + 1).alias("copy_parallelism"), (F.col("page_id") % 50 == 7).alias("gone"),
        F.concat(F.lit("compacted/page-"), F.col("page_id").cast("string"), F.lit(".sst")).alias("object_name"), F.encode("html", "UTF-8").alias("content"),
    )
    objects.put_objects(pages.filter("NOT gone"), f"{root}/source").write.parquet(f"{root}/written")
    plan = pages.select(
        *PAIR, "copy_parallelism", "object_name", F.concat(F.lit(f"{root}/source/"), "object_name").alias("source"),
        F.concat(F.lit(f"{root}/"), "target", F.lit("/"), F.col("db_key").cast("string"), F.lit("/"), "object_name").alias("dest"),
    )
    return objects.copied_totals(objects.copy_rows(plan, PAIR), PAIR)


@query("snk3_object_copy", "SELECT concat('wal/page-', CAST(page_id AS VARCHAR), '.sst') AS name, octet_length(CAST(html AS BLOB)) AS bytes, CAST(NULL AS VARCHAR) AS error FROM pages".replace("octet_length(CAST(html AS BLOB))", "strlen(html)"))
def snk3(fx: Fixtures) -> DataFrame:
    """Every page written as an object and copied by the executors."""
    root = shared_dir(fx.spark, "objects")
    pages = fx.table("pages").select(
        F.concat(F.lit("wal/page-"), F.col("page_id").cast("string"), F.lit(".sst")).alias("object_name"),
        F.encode("html", "UTF-8").alias("content"),
    )
    written = objects.put_objects(pages, f"{root}/source")
    # The copy reads the names from the finished write, so it cannot run early.
    written.write.parquet(f"{root}/written")
    plan = fx.spark.read.parquet(f"{root}/written").select(F.col("name").alias("object_name"))
    return objects.copy_objects(plan, f"{root}/source", f"{root}/dest")


@query(
    "src1_listed_objects",
    "SELECT concat('manifest/page-', CAST(page_id AS VARCHAR)) AS object_name, CASE WHEN page_id % 3 = 0 THEN 0 ELSE strlen(url) END AS size FROM pages",
)
def src1_listed(fx: Fixtures) -> DataFrame:
    """A root with an object per page, a hundred to a folder and every third one empty, listed."""
    root = shared_dir(fx.spark, "listing")
    pages = fx.table("pages").select(
        F.concat(F.lit("part-"), F.floor(F.col("page_id") / 100).cast("string"), F.lit("/manifest/page-"), F.col("page_id").cast("string")).alias("object_name"),
        F.when(F.col("page_id") % 3 == 0, F.encode(F.lit(""), "UTF-8")).otherwise(F.encode("url", "UTF-8")).alias("content"),
    )
    objects.put_objects(pages, root).write.format("noop").mode("overwrite").save()
    roots = fx.spark.createDataFrame([(root,)], "root string")
    name = F.regexp_extract("path", "(manifest/.*)$", 1).alias("object_name")
    return listings.list_objects(roots).select(name, "size")


@query(
    "snk1_created_objects",
    "SELECT concat('page-', CAST(page_id AS VARCHAR)) AS object_name, CASE WHEN page_id % 4 > 0 THEN 'created' WHEN page_id % 12 = 0 THEN 'diverged' ELSE 'same' END AS outcome FROM pages",
)
def snk1_created(fx: Fixtures) -> DataFrame:
    """Pages written where another writer has been: a quarter is there, a third of that with other content."""
    root, key = shared_dir(fx.spark, "created"), F.col("page_id")
    name, content = F.concat(F.lit("page-"), key.cast("string")).alias("object_name"), F.encode("url", "UTF-8")
    pages = fx.table("pages")
    theirs = pages.filter(key % 4 == 0).select(name, F.when(key % 12 == 0, F.encode(F.lit("theirs"), "UTF-8")).otherwise(content).alias("content"))
    conditional.create_objects(theirs, root).write.format("noop").mode("overwrite").save()
    return settle(conditional.create_objects(pages.select(name, content.alias("content")), root), "created")


@query(
    "snk2_committed_objects",
    """SELECT db_key, page_id, CASE WHEN foreign_before > 0 THEN 'stopped' WHEN other THEN 'diverged' WHEN mine THEN 'same' ELSE 'created' END AS outcome FROM
      (SELECT *, count(*) FILTER (WHERE other) OVER (PARTITION BY db_key ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS foreign_before
       FROM (SELECT page_id % 16 AS db_key, page_id, page_id % 5 = 0 AS mine, page_id % 16 < 4 AND page_id % 97 = 50 AS other FROM pages))""",
)
def snk2_committed(fx: Fixtures) -> DataFrame:
    """Pages committed per database in order: some are there, and in some databases others wrote one."""
    root, key = shared_dir(fx.spark, "committed"), F.col("page_id")
    pair = key % 16
    name = F.concat(pair.cast("string"), F.lit("/manifest/"), F.lpad(key.cast("string"), 20, "0"), F.lit(".manifest"))
    content, other = F.encode("url", "UTF-8"), (pair < 4) & (key % 97 == 50)
    pages = fx.table("pages")
    held = pages.filter((key % 5 == 0) | other).select(
        name.alias("object_name"), F.when(other, F.encode(F.lit("theirs"), "UTF-8")).otherwise(content).alias("content")
    )
    conditional.create_objects(held, root).write.format("noop").mode("overwrite").save()
    members = pages.select(pair.alias("db_key"), key, F.concat(F.lit(f"{root}/"), name).alias("dest"), content.alias("content"))
    return settle(conditional.commit_objects(members, ["db_key"], "page_id"), "committed")


@query(
    "src3_fetched_bodies",
    "SELECT concat('node-', CAST(page_id % 50 AS VARCHAR)) AS node_id, CASE WHEN max(page_id) % 7 <> 3 THEN arg_max(url, page_id) END AS body FROM pages GROUP BY page_id % 50",
)
def src3_fetched(fx: Fixtures) -> DataFrame:
    """The body of each node's youngest object, the only ones opened; some of these are gone."""
    root, key = shared_dir(fx.spark, "bodies"), F.col("page_id")
    written = fx.table("pages").select(
        F.concat(F.lit("nodes/page-"), key.cast("string")).alias("object_name"), F.encode("url", "UTF-8").alias("content")
    ).filter(key % 7 != 3)
    objects.put_objects(written, root).write.format("noop").mode("overwrite").save()
    known = fx.table("pages").select(
        F.concat(F.lit("node-"), (key % 50).cast("string")).alias("node_id"), F.lit(None).cast("array<string>").alias("services"),
        (-key).alias("age_micros"), F.concat(F.lit(f"{root}/nodes/page-"), key.cast("string")).alias("location"),
        F.lit(None).cast("timestamp").alias("last_modified"),
    )
    youngest = settle(liveness.youngest_per_node(known), "youngest")
    return youngest.join(documents.fetch_bodies(youngest), "location", "left").select("node_id", "body")


# ----------------------------------------------------------- ordered ids


def floors(fx: Fixtures) -> DataFrame:
    """Tail floor per database: the smallest id there is."""
    return fx.wal.groupBy("db_key").agg(F.min("wal_id").alias("floor"))


TAIL_VIEWS = {
    "fx_floor": "SELECT db_key, min(wal_id) AS floor FROM fx_wal GROUP BY db_key",
    "fx_run": "SELECT db_key, wal_id FROM (SELECT w.db_key, w.wal_id, f.floor, row_number() OVER (PARTITION BY w.db_key ORDER BY w.wal_id) AS n FROM fx_wal w JOIN fx_floor f USING (db_key) WHERE w.wal_id >= f.floor) WHERE wal_id - floor = n - 1",
}


@query("wn4_contiguous_run", "SELECT * FROM fx_run", TAIL_VIEWS)
def wn4(fx: Fixtures) -> DataFrame:
    """WAL ids that can be tailed from each floor without a gap."""
    return ordered.contiguous_run(fx.wal, floors(fx), ["db_key"], "wal_id", "floor")


@query("wn4_tail_runs", "SELECT f.db_key, f.floor, max(r.wal_id) + 1 AS next FROM fx_floor f JOIN fx_run r USING (db_key) GROUP BY f.db_key, f.floor", TAIL_VIEWS)
def wn4_runs(fx: Fixtures) -> DataFrame:
    """How far each tail gets from its floor: a row per database, whatever its length."""
    return intervals.dense_until(intervals.as_runs(fx.wal, ["db_key"], "wal_id"), floors(fx), ["db_key"], "floor")


LAGGING = "wal_id < (SELECT max(o_orderkey) FROM orders) - 260 + 60 * db_key"
TARGET_TAIL_VIEWS = {
    "fx_start": f"""SELECT h.db_key, h.target, greatest(m.next_wal_sst_id, coalesce(w.last + 1, 0)) AS floor FROM fx_dst_head h JOIN fx_dst_manifest m ON m.db_key = h.db_key AND m.manifest_id = h.watermark
      LEFT JOIN (SELECT db_key, max(wal_id) AS last FROM fx_wal WHERE {LAGGING} GROUP BY db_key) w ON w.db_key = h.db_key""",
    "fx_after": "SELECT w.db_key, s.target, w.wal_id, s.floor, row_number() OVER (PARTITION BY w.db_key ORDER BY w.wal_id) AS n FROM fx_wal w JOIN fx_start s USING (db_key) WHERE w.wal_id >= s.floor",
}


def target_tail_starts(fx: Fixtures) -> DataFrame:
    """Where the tails of targets start that lag behind by database."""
    bound = F.lit(fx._top_order() - 260) + F.col("db_key") * 60
    listing = fx.wal.filter(F.col("wal_id") < bound).select("db_key", F.lit(TARGET).alias("target"), F.lit("wal").alias("kind"), "wal_id")
    return mirror.tail_starts(fx.dst_manifest, listing)


@query("wn4_tail_starts", "SELECT * FROM fx_start", TARGET_TAIL_VIEWS)
def wn4_starts(fx: Fixtures) -> DataFrame:
    """Where each target's tail starts: after its last WAL, or at its newest manifest's open ones."""
    return target_tail_starts(fx)


@query("wn4_target_tail", "SELECT db_key, target, wal_id FROM fx_after WHERE wal_id - floor = n - 1", TARGET_TAIL_VIEWS)
def wn4_target(fx: Fixtures) -> DataFrame:
    """WAL ids that can be tailed to each target now."""
    wal = fx.wal.withColumn("target", F.lit(TARGET))
    return ordered.contiguous_run(wal, target_tail_starts(fx), PAIR, "wal_id", "floor").select(*PAIR, "wal_id")


@query(
    "wn5_gap_report",
    "SELECT db_key, wal_id + 1 AS gap_start, nxt - 1 AS gap_end FROM (SELECT *, lead(wal_id) OVER (PARTITION BY db_key ORDER BY wal_id) AS nxt FROM fx_wal) WHERE nxt > wal_id + 1",
)
def wn5(fx: Fixtures) -> DataFrame:
    """Every hole in every database's WAL ids."""
    return ordered.gaps(fx.wal, ["db_key"], "wal_id")


ASOF_VIEW = {
    "fx_mapped": "SELECT m.db_key, m.manifest_id, m.last_l0_seq, s.ts AS mapped_ts FROM fx_manifest m ASOF LEFT JOIN fx_seq s ON m.last_l0_seq >= s.seq",
}


@query("jn10_asof_times", "SELECT db_key, manifest_id, mapped_ts FROM fx_mapped", ASOF_VIEW)
def jn10(fx: Fixtures) -> DataFrame:
    """When every manifest's state was written, rounding down."""
    rows = fx.manifest.select("db_key", "manifest_id", "last_l0_seq")
    return restore.snapshot_times(rows, fx.seq, []).select("db_key", "manifest_id", "mapped_ts")


# ---------------------------------------------------------------- restore


def restore_requests(fx: Fixtures) -> DataFrame:
    """Per customer a request: latest, an id, or a time; one in ten to a used root."""
    key = F.col("c_custkey")
    mode = F.when(key % 4 == 0, "latest").when(key % 4 == 1, "id").otherwise("time")
    start = F.unix_micros(F.lit("2023-12-31 20:00:00").cast("timestamp"))
    at = F.timestamp_micros(start + key * 1_234_567_891).cast("timestamp_ntz")
    return fx.table("customer").select(
        key.alias("request_id"), (key % 21).alias("db_key"),
        F.concat(F.lit("s3://restore/"), key.cast("string")).alias("dest"),
        mode.alias("mode"),
        F.when(mode == "id", key * 9).alias("want_id"),
        F.when(mode == "time", at).alias("at"),
    )


RESTORE_VIEWS = {
    **ASOF_VIEW,
    "fx_request": """SELECT c_custkey AS request_id, c_custkey % 21 AS db_key, c_custkey % 10 = 3 AS used, CASE c_custkey % 4 WHEN 0 THEN 'latest' WHEN 1 THEN 'id' ELSE 'time' END AS mode, c_custkey * 9 AS want_id, make_timestamp(epoch_us(TIMESTAMP '2023-12-31 20:00:00') + c_custkey * 1234567891) AS at FROM customer""",
    "fx_top": "SELECT db_key, max(manifest_id) AS latest FROM fx_manifest GROUP BY db_key",
    "fx_chosen": """SELECT r.*, t.latest, CASE mode WHEN 'latest' THEN t.latest WHEN 'id' THEN (SELECT max(m.manifest_id) FROM fx_manifest m WHERE m.db_key = r.db_key AND m.manifest_id = r.want_id) ELSE (SELECT max(m.manifest_id) FROM fx_mapped m WHERE m.db_key = r.db_key AND m.mapped_ts <= r.at) END AS chosen FROM fx_request r LEFT JOIN fx_top t USING (db_key)""",
    "fx_pins": f"SELECT DISTINCT c.db_key, c.manifest_id AS head, c.pinned_id AS member_id FROM fx_checkpoint c WHERE {LIVE} AND c.pinned_id <> c.manifest_id",
    "fx_open": "SELECT * FROM fx_chosen WHERE NOT used AND chosen IS NOT NULL",
    "fx_rmember": "SELECT request_id, db_key, chosen AS member_id FROM fx_open UNION SELECT o.request_id, o.db_key, p.member_id FROM fx_open o JOIN fx_pins p ON p.db_key = o.db_key AND p.head = o.chosen",
    "fx_robject": "SELECT DISTINCT m.request_id, o.kind, o.object_name FROM fx_rmember m JOIN fx_object o ON o.db_key = m.db_key AND o.manifest_id = m.member_id",
}


def restores(fx: Fixtures) -> restore.RestorePlan:
    backup = snapshot.Catalog(fx.manifest, fx._objects(fx.manifest, ["db_key"]), fx.checkpoint)
    requests = restore_requests(fx)
    occupied = requests.filter(F.col("request_id") % 10 == 3).select("dest")
    return restore.restore_plan(backup, requests, fx.seq, occupied, fx.mirror_now, [])


@query(
    "jn11_restore_points",
    "SELECT request_id, db_key, mode, latest, chosen FROM fx_chosen",
    RESTORE_VIEWS,
)
def jn11(fx: Fixtures) -> DataFrame:
    """The snapshot each request resolves to."""
    backup = snapshot.Catalog(fx.manifest, fx.sst, fx.checkpoint)
    return restore.resolve_points(backup, restore_requests(fx), fx.seq, []).select(
        "request_id", "db_key", "mode", "latest", "chosen"
    )


@query(
    "jb4_restore_outcomes",
    """SELECT c.request_id, c.db_key, c.mode, CASE WHEN used OR chosen IS NULL THEN NULL ELSE chosen END AS manifest_id, coalesce(m.n, 0) AS manifests_committed, coalesce(o.n, 0) AS copied_objects,
      CASE WHEN used THEN 'target holds data already' WHEN latest IS NULL THEN 'no manifests at the source' WHEN chosen IS NULL AND mode = 'id' THEN 'manifest unknown' WHEN chosen IS NULL THEN 'earlier than the first recorded time' END AS error
    FROM fx_chosen c LEFT JOIN (SELECT request_id, count(*) AS n FROM fx_rmember GROUP BY 1) m USING (request_id) LEFT JOIN (SELECT request_id, count(*) AS n FROM fx_robject GROUP BY 1) o USING (request_id)""",
    RESTORE_VIEWS,
)
def jb4(fx: Fixtures) -> DataFrame:
    """What each restore would commit and copy, or why it is refused."""
    return restores(fx).outcomes


@query(
    "jb4_restore_commits",
    "SELECT request_id, member_id AS manifest_id, row_number() OVER (PARTITION BY request_id ORDER BY member_id) AS commit_seq FROM fx_rmember",
    RESTORE_VIEWS,
)
def jb4_commits(fx: Fixtures) -> DataFrame:
    """Manifests each restore commits, in order."""
    return restores(fx).commits


# -------------------------------------------------------------------- lag

LAG_VIEWS = {
    "fx_src_top": "SELECT db_key, max(manifest_id) AS sid, max_by(last_l0_seq, manifest_id) AS sseq FROM fx_src_manifest GROUP BY db_key",
    "fx_dst_top": "SELECT db_key, max(manifest_id) AS did, max_by(last_l0_seq, manifest_id) AS dseq FROM fx_dst_manifest GROUP BY db_key",
    "fx_lag": """SELECT p.db_key, p.target, sid AS source_manifest_id, did AS dest_manifest_id, CASE WHEN sid IS NOT NULL THEN greatest(0, sid - coalesce(did, 0)) END AS manifests_behind,
      CASE WHEN did IS NOT NULL THEN CASE WHEN sw.w IS NOT NULL THEN greatest(0, sw.w - coalesce(dw.w, 0)) END END AS wal_behind,
      CASE WHEN did IS NOT NULL THEN greatest(0, CAST(floor((epoch_us((SELECT max_by(ts, seq) FROM fx_seq WHERE seq <= sseq)) - epoch_us((SELECT max_by(ts, seq) FROM fx_seq WHERE seq <= dseq))) / 1000000) AS BIGINT)) END AS seconds_behind
      FROM fx_pair p LEFT JOIN fx_src_top USING (db_key) LEFT JOIN fx_dst_top USING (db_key)
      LEFT JOIN (SELECT db_key, max(wal_id) AS w FROM fx_src_wal GROUP BY 1) sw USING (db_key) LEFT JOIN (SELECT db_key, max(wal_id) AS w FROM fx_dst_object GROUP BY 1) dw USING (db_key)""",
    "fx_lag_error": """SELECT db_key, target, CASE WHEN db_key % 8 <> 6 THEN source_manifest_id END AS source_manifest_id, CASE WHEN db_key % 8 <> 6 THEN dest_manifest_id END AS dest_manifest_id, CASE WHEN db_key % 8 <> 6 THEN manifests_behind END AS manifests_behind, CASE WHEN db_key % 8 <> 6 THEN wal_behind END AS wal_behind, CASE WHEN db_key % 8 <> 6 THEN seconds_behind END AS seconds_behind, CASE WHEN db_key % 8 = 6 THEN 'timed out after 10s' END AS error FROM fx_lag""",
}


def lag_report(fx: Fixtures, failures: DataFrame | None = None) -> DataFrame:
    return lag.mirror_lag(
        fx.pair.select(*PAIR), fx.src_manifest, fx.dst_manifest, fx.src_wal,
        fx.dst_object.filter("kind = 'wal'"), fx.seq, [], failures,
    )


def probe_failures(fx: Fixtures) -> DataFrame:
    return fx.pair.filter(F.col("db_key") % 8 == 6).select(*PAIR, F.lit("timed out after 10s").alias("error"))


@query("jb5_mirror_lag", "SELECT *, CAST(NULL AS VARCHAR) AS error FROM fx_lag", LAG_VIEWS)
def jb5(fx: Fixtures) -> DataFrame:
    """How far every mirror trails."""
    return lag_report(fx)


@query("jn14_probe_errors", "SELECT * FROM fx_lag_error", LAG_VIEWS)
def jn14(fx: Fixtures) -> DataFrame:
    """The lag report when some pairs cannot be read."""
    return lag_report(fx, probe_failures(fx))


def _json_sql(columns: list[tuple[str, bool]]) -> str:
    parts = [
        f"""CASE WHEN {c} IS NOT NULL THEN concat('"{c}":', {f"concat('\"', {c}, '\"')" if text else f"CAST({c} AS VARCHAR)"}) END""" for c, text in columns
    ]
    return f"concat('{{', concat_ws(',', {', '.join(parts)}), '}}')"


LAG_COLUMNS = [
    ("db_key", False), ("target", True), ("source_manifest_id", False), ("dest_manifest_id", False),
    ("manifests_behind", False), ("wal_behind", False), ("seconds_behind", False), ("error", True),
]


@query("snk6_json_responses", f"SELECT db_key, target, {_json_sql(LAG_COLUMNS)} AS response FROM fx_lag_error", LAG_VIEWS)
def snk6(fx: Fixtures) -> DataFrame:
    """Lag rows as JSON, absent values left out."""
    report = lag_report(fx, probe_failures(fx)).select(*[c for c, _ in LAG_COLUMNS])
    return responses.as_json(report, PAIR)


@query(
    "sm5_due_cuts",
    f"""SELECT p.db_key, p.target, t.last_modified, coalesce(epoch_us(TIMESTAMP '{MIRROR_NOW}') - epoch_us(t.last_modified) >= 86400000000 * 30, true) AS due
    FROM fx_pair p LEFT JOIN (SELECT db_key, max_by(last_modified, manifest_id) AS last_modified FROM fx_dst_manifest GROUP BY db_key) t USING (db_key)""",
)
def sm5(fx: Fixtures) -> DataFrame:
    """Periodic targets whose next cut is due, at one cut per 30 days."""
    from quayside.streaming.periodic import due_cuts

    return due_cuts(fx.pair.withColumn("interval_s", F.lit(30 * 86_400.0)), fx.dst_manifest, fx.mirror_now).select(
        *PAIR, "last_modified", "due"
    )


CUT_VIEWS = {
    "fx_moment": "SELECT db_key, last_modified, max(manifest_id) AS manifest_id FROM fx_src_manifest GROUP BY ALL",
    "fx_link": "SELECT db_key, last_modified, min(last_modified) OVER (PARTITION BY db_key ORDER BY last_modified RANGE BETWEEN INTERVAL 30 DAYS FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM fx_moment",
    "fx_first": "SELECT db_key, min(last_modified) AS last_modified FROM fx_moment GROUP BY db_key",
}


@query(
    "sm5_cut_history",
    """SELECT c.db_key, p.target, m.manifest_id, c.last_modified FROM (
      WITH RECURSIVE cut AS (SELECT * FROM fx_first UNION ALL SELECT l.db_key, l.following FROM cut JOIN fx_link l ON l.db_key = cut.db_key AND l.last_modified = cut.last_modified WHERE l.following IS NOT NULL)
      SELECT * FROM cut) c JOIN fx_moment m ON m.db_key = c.db_key AND m.last_modified = c.last_modified JOIN fx_pair p ON p.db_key = c.db_key""",
    CUT_VIEWS,
)
def sm5_history(fx: Fixtures) -> DataFrame:
    """Every cut that targets with one per 30 days have made of their sources' histories."""
    from quayside.streaming.periodic import cut_history

    return cut_history(fx.src_manifest, fx.pair.withColumn("interval_s", F.lit(30 * 86_400.0)))


# --------------------------------------------------------------- retention

PRUNE_VIEWS = {
    "fx_active": "SELECT * FROM fx_policy WHERE keep_s IS NOT NULL",
    "fx_point": f"""SELECT m.db_key, m.manifest_id, m.readable FROM fx_dst_manifest m JOIN fx_active a USING (db_key) JOIN fx_dst_head h USING (db_key) WHERE m.manifest_id = h.watermark OR epoch_us(TIMESTAMP '{MIRROR_NOW}') - epoch_us(m.last_modified) < {int(KEEP_SECONDS)}000000""",
    "fx_kept": f"""SELECT * FROM fx_point UNION SELECT m.db_key, m.manifest_id, m.readable FROM fx_point p JOIN fx_dst_cp c ON c.db_key = p.db_key AND c.manifest_id = p.manifest_id JOIN fx_dst_manifest m ON m.db_key = c.db_key AND m.manifest_id = c.pinned_id WHERE p.readable AND {LIVE}""",
    "fx_src_pin": "SELECT c.* FROM fx_src_cp c JOIN fx_src_head h ON h.db_key = c.db_key AND h.head = c.manifest_id",
    "fx_pin_floor": f"SELECT a.db_key, min(epoch_us(create_time)) - {int(MIN_AGE_SECONDS)}000000 AS floor FROM fx_src_pin c JOIN fx_active a USING (db_key) WHERE c.pinned_id % 10 = 0 GROUP BY a.db_key",
    "fx_spared": "SELECT DISTINCT o.db_key, o.object_name FROM (SELECT db_key, head AS manifest_id FROM fx_src_head UNION SELECT db_key, pinned_id FROM fx_src_pin) m JOIN fx_src_manifest s USING (db_key, manifest_id) JOIN fx_object o USING (db_key, manifest_id)",
    "fx_referenced": "SELECT DISTINCT o.db_key, o.object_name FROM fx_kept k JOIN fx_object o USING (db_key, manifest_id)",
    "fx_guard": """SELECT a.db_key, a.target, CASE WHEN NOT EXISTS (SELECT 1 FROM fx_src_head s WHERE s.db_key = a.db_key) THEN 'source unreachable' WHEN EXISTS (SELECT 1 FROM fx_kept k WHERE k.db_key = a.db_key AND NOT k.readable) THEN 'a kept manifest is unreadable' END AS held,
      CASE WHEN m.readable THEN m.next_wal_sst_id ELSE 0 END AS tail_floor, f.floor FROM fx_active a JOIN fx_dst_head h USING (db_key) JOIN fx_dst_manifest m ON m.db_key = a.db_key AND m.manifest_id = h.watermark LEFT JOIN fx_pin_floor f ON f.db_key = a.db_key""",
    "fx_reason": f"""SELECT d.db_key, g.target, d.kind, d.object_name, CASE WHEN held IS NOT NULL THEN held WHEN d.kind = 'wal' AND d.wal_id >= g.tail_floor THEN 'WAL tail' WHEN r.object_name IS NOT NULL THEN 'referenced by a kept manifest' WHEN s.object_name IS NOT NULL THEN 'in the source''s closure'
      WHEN epoch_us(TIMESTAMP '{MIRROR_NOW}') - epoch_us(d.last_modified) <= {int(MIN_AGE_SECONDS)}000000 THEN 'too young' WHEN epoch_us(d.last_modified) >= g.floor THEN 'newer than the oldest pin' END AS why
      FROM fx_dst_object d JOIN fx_guard g USING (db_key) LEFT JOIN fx_referenced r ON r.db_key = d.db_key AND r.object_name = d.object_name LEFT JOIN fx_spared s ON s.db_key = d.db_key AND s.object_name = d.object_name""",
    "fx_decision": """SELECT m.db_key, m.target, 'manifest' AS kind, concat('manifest/', lpad(CAST(m.manifest_id AS VARCHAR), 20, '0'), '.manifest') AS object_name, CASE WHEN k.manifest_id IS NULL THEN 'delete' ELSE 'keep' END AS decision, CASE WHEN k.manifest_id IS NULL THEN 'expired' ELSE 'restore point or support' END AS reason
      FROM fx_dst_manifest m JOIN fx_active a USING (db_key) LEFT JOIN fx_kept k ON k.db_key = m.db_key AND k.manifest_id = m.manifest_id
      UNION ALL SELECT db_key, target, kind, object_name, CASE WHEN why IS NULL THEN 'delete' ELSE 'keep' END, coalesce(why, 'unreferenced') FROM fx_reason""",
}


def prune(fx: Fixtures) -> DataFrame:
    return retention.prune_plan(fx.source, fx.dest, fx.dst_object, fx.retention_policy, fx.mirror_now)


@query("jb3_prune_decisions", "SELECT * FROM fx_decision", PRUNE_VIEWS)
def jb3(fx: Fixtures) -> DataFrame:
    """Keep or delete, and why, for everything at every target."""
    return prune(fx)


@query(
    "snk4_prune_order",
    "SELECT db_key, target, kind, object_name, CASE WHEN kind = 'manifest' THEN 1 ELSE 2 END::BIGINT AS phase FROM fx_decision WHERE decision = 'delete'",
    PRUNE_VIEWS,
)
def snk4_order(fx: Fixtures) -> DataFrame:
    """What to delete, manifests before data."""
    return retention.delete_order(prune(fx))


@query("ag8_pin_floor", f"SELECT db_key, '{TARGET}' AS target, floor FROM fx_pin_floor", PRUNE_VIEWS)
def ag8(fx: Fixtures) -> DataFrame:
    """The oldest pin of every target, less the minimum age."""
    active = fx.retention_policy.filter("keep_s IS NOT NULL")
    roots = snapshot.heads(fx.source.manifests).select("db_key", "manifest_id")
    listed = fx.source.checkpoints.join(roots, ["db_key", "manifest_id"], "left_semi")
    return retention.pin_floor(listed, active, "mirror:")


@query(
    "jn9_unreferenced_objects",
    "SELECT db_key, object_name FROM fx_dst_object d WHERE NOT EXISTS (SELECT 1 FROM fx_referenced r WHERE r.db_key = d.db_key AND r.object_name = d.object_name) AND NOT EXISTS (SELECT 1 FROM fx_spared s WHERE s.db_key = d.db_key AND s.object_name = d.object_name)",
    PRUNE_VIEWS,
)
def jn9(fx: Fixtures) -> DataFrame:
    """Listed objects neither a kept manifest nor the source references."""
    kept = retention.kept_manifests(fx.dest, fx.retention_policy.filter("keep_s IS NOT NULL"), fx.mirror_now)
    referenced = fx.dest.objects.join(kept, [*PAIR, "manifest_id"], "left_semi")
    on = ["db_key", "object_name"]
    return (
        fx.dst_object.select(on).join(referenced.select(on), on, "left_anti")
        .join(retention.spared_objects(fx.source).select(on), on, "left_anti")
    )


def after_commit(views: dict[str, str]) -> dict[str, str]:
    """The same views over the target as the pass leaves it."""
    out = {
        "fx_new_manifest": "SELECT * FROM fx_dst_manifest UNION ALL BY NAME SELECT s.*, c.target, true AS readable FROM fx_src_manifest s JOIN fx_commit c USING (db_key, manifest_id)",
        "fx_new_head": "SELECT db_key, target, max(manifest_id) AS watermark FROM fx_new_manifest GROUP BY db_key, target",
        "fx_new_cp": "SELECT c.* FROM fx_checkpoint c SEMI JOIN fx_new_manifest m USING (db_key, manifest_id)",
        "fx_new_object": f"SELECT * FROM fx_dst_object UNION ALL BY NAME SELECT db_key, target, kind, object_name, CASE WHEN kind = 'wal' THEN CAST(regexp_extract(object_name, '([0-9]+)', 1) AS BIGINT) END AS wal_id, TIMESTAMP '{MIRROR_NOW}' AS last_modified FROM fx_copy",
    }
    for name, sql in views.items():
        for part in ("manifest", "head", "cp", "object"):
            sql = sql.replace(f"fx_dst_{part}", f"fx_new_{part}")
        out[name] = sql
    return out


@query(
    "jb10_sync_and_prune_summary",
    f"""SELECT c.db_key, c.target, c.class, c.head, c.class IN ('copy and commit', 'commit only') AS committed, coalesce(m.n, 0) AS manifests_committed, coalesce(o.n, 0) AS objects_copied, coalesce(o.b, 0) AS bytes_copied, coalesce(d.pm, 0) AS pruned_manifests, coalesce(d.po, 0) AS pruned_objects
    FROM fx_class c LEFT JOIN (SELECT db_key, count(*) AS n FROM fx_commit GROUP BY 1) m USING (db_key) LEFT JOIN (SELECT db_key, count(*) AS n, CAST(sum({SIZE}) AS BIGINT) AS b FROM fx_copy GROUP BY 1) o USING (db_key)
    LEFT JOIN (SELECT db_key, count(*) FILTER (WHERE kind = 'manifest') AS pm, count(*) FILTER (WHERE kind <> 'manifest') AS po FROM fx_decision WHERE decision = 'delete' GROUP BY 1) d USING (db_key)""",
    {**SYNC_VIEWS, **after_commit(PRUNE_VIEWS)},
)
def jb10(fx: Fixtures) -> DataFrame:
    """One row per pair: the pass and the prune that follows it."""
    listing = sizes(fx.source.objects.select("db_key", "kind", "object_name").distinct())
    plan = sync(fx)
    dest, objects = mirror.committed_state(fx.source, fx.dest, fx.dst_object, plan.commits, plan.copies, fx.mirror_now)
    decisions = retention.prune_plan(fx.source, dest, objects, fx.retention_policy, fx.mirror_now)
    return mirror.sync_summary(plan, decisions, listing)


# ------------------------------------------------------------------ audits


@query(
    "jb6_completeness_audit",
    f"""SELECT db_key, target, manifest_id, concat('manifest/', lpad(CAST(manifest_id AS VARCHAR), 20, '0'), '.manifest') AS object_name, 'pinned manifest missing' AS problem FROM fx_need n WHERE NOT EXISTS (SELECT 1 FROM fx_dst_manifest m WHERE m.db_key = n.db_key AND m.manifest_id = n.manifest_id)
    UNION ALL SELECT n.db_key, n.target, n.manifest_id, o.object_name, 'object missing' FROM fx_need n JOIN fx_dst_manifest m USING (db_key, manifest_id) JOIN fx_object o USING (db_key, manifest_id) WHERE NOT EXISTS (SELECT 1 FROM fx_dst_object d WHERE d.db_key = n.db_key AND d.object_name = o.object_name)""",
    {
        "fx_need": f"""SELECT db_key, target, watermark AS manifest_id FROM fx_dst_head UNION SELECT h.db_key, h.target, c.pinned_id FROM fx_dst_head h JOIN fx_dst_cp c ON c.db_key = h.db_key AND c.manifest_id = h.watermark WHERE {LIVE} AND c.pinned_id <> h.watermark
          AND EXISTS (SELECT 1 FROM fx_src_cp s JOIN fx_src_head t ON t.db_key = s.db_key AND t.head = s.manifest_id WHERE s.db_key = c.db_key AND s.cp_id = c.cp_id)""",
    },
)
def jb6(fx: Fixtures) -> DataFrame:
    """Everything a target's latest state needs and lacks."""
    return audits.completeness_problems(fx.source, fx.dest, fx.dst_object, fx.mirror_now)
