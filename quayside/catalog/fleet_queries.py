"""Queries over heartbeats, the registry, settings, targets and placement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.catalog.fixtures import HEARTBEAT_NOW, HEARTBEAT_TIMEOUT, Fixtures
from quayside.catalog.name_queries import byte_list
from quayside.catalog.registration import query
from quayside.functions.names import registry_name
from quayside.operators import liveness, placement, registry, settings, targets
from quayside.operators.reconcile import reconcile
from quayside.operators.sets import with_self
from quayside.plans import audits, status
from quayside.session import settle
from quayside.sources import documents, listings


def entries(fx: Fixtures) -> DataFrame:
    return listings.heartbeat_entries(fx.heartbeat_listing, fx.heartbeat_now)


def live(fx: Fixtures) -> DataFrame:
    return liveness.live_nodes(entries(fx), HEARTBEAT_TIMEOUT)


def resolved(fx: Fixtures) -> DataFrame:
    return settings.resolve(fx.database, fx.override, fx.fleet)


def applied(fx: Fixtures) -> DataFrame:
    inherited, _ = settings.merge_targets(fx.target_with_exact, fx.target_override)
    return targets.applied_targets(fx.database, inherited)


def wanted(fx: Fixtures) -> DataFrame:
    return status.assignments(resolved(fx), applied(fx))


# ------------------------------------------------------------------ sources


@query("src1_object_listing", "SELECT location AS path, last_modified FROM fx_heartbeat")
def src1(fx: Fixtures) -> DataFrame:
    """The listing under ``nodes/``, from an inventory table."""
    return fx.heartbeat_listing


@query(
    "src2_heartbeat_listing",
    f"""SELECT node_id, CASE letters WHEN 'g' THEN 'gc' WHEN 'c' THEN 'compactor-coordinator' WHEN 'w' THEN 'compaction-workers' WHEN 'm' THEN 'mirror' ELSE '' END AS services, greatest(0, epoch_us(TIMESTAMP '{HEARTBEAT_NOW}') - epoch_us(last_modified)) AS age_micros, location FROM fx_heartbeat""",
)
def src2(fx: Fixtures) -> DataFrame:
    """Heartbeat names taken apart, with their age."""
    return entries(fx).select("node_id", F.array_join("services", ",").alias("services"), "age_micros", "location")


def bodies(fx: Fixtures) -> DataFrame:
    """A JSON body per heartbeat object; some are cut off, some are gone."""
    number = F.regexp_extract("path", "node-([0-9]+)", 1).cast("bigint")
    text = F.concat(
        F.lit('{"version":1,"node_id":"node-'), number.cast("string"), F.lit('","agent_version":"0.'),
        (number % 5).cast("string"), F.lit('","future_field":[1],"services":[{"service":"gc","running":'),
        (number % 50).cast("string"), F.lit(',"backoff":1}]}'),
    )
    body = F.when(number % 10 == 3, F.substring(text, 1, 40)).when(number % 10 != 7, text)
    return fx.heartbeat_listing.select(F.col("path").alias("location"), body.alias("body"))


@query(
    "src3_heartbeat_bodies",
    """SELECT node_id, location, CASE WHEN n % 10 NOT IN (3, 7) THEN concat('0.', CAST(n % 5 AS VARCHAR)) END AS agent_version, CASE WHEN n % 10 NOT IN (3, 7) THEN n % 50 END AS running FROM (SELECT *, CAST(replace(node_id, 'node-', '') AS BIGINT) AS n FROM fx_node)""",
)
def src3(fx: Fixtures) -> DataFrame:
    """Versions and task counts from each node's youngest body, if readable."""
    youngest = liveness.youngest_per_node(entries(fx))
    return documents.with_heartbeat_bodies(youngest, bodies(fx), ("agent_version",)).select(
        "node_id", "location", "agent_version", F.col("task_counts")[0]["running"].alias("running")
    )


def registry_listing(fx: Fixtures) -> DataFrame:
    """A registry file per database; some have a second spelling, some are junk."""
    key, url = F.col("db_key"), F.col("db_url")
    spellings = F.array_compact(
        F.array(
            F.when(key % 6 != 5, registry_name(url)),
            F.when(key % 4 == 0, registry_name(F.concat(url, F.lit("/")))),
            F.when(key % 6 == 5, registry_name(F.replace(url, F.lit("s3://data"), F.lit("S3://Data")))),
            F.when(key % 10 == 1, F.concat(F.lit("README-"), key.cast("string"), F.lit(".md"))),
            F.when(key % 10 == 2, F.concat(F.lit("s3%FF"), key.cast("string"), F.lit(".toml"))),
            F.when(key % 10 == 3, registry_name(F.replace(url, F.lit("s3:"), F.lit("ftp:")))),
        )
    )
    return fx.database.select(
        F.explode(F.transform(spellings, lambda s: F.concat(F.lit("dbs/"), s))).alias("path"),
        F.when(key % 3 == 0, F.lit(0)).otherwise(F.lit(120)).cast("bigint").alias("size"),
    )


REGISTRY_VIEWS = {
    "fx_reg": """SELECT db_key, CASE WHEN db_key % 3 = 0 THEN 0 ELSE 120 END::BIGINT AS size, unnest(list_filter([
        CASE WHEN db_key % 6 <> 5 THEN concat(url_encode(db_url), '.toml') END,
        CASE WHEN db_key % 4 = 0 THEN concat(url_encode(concat(db_url, '/')), '.toml') END,
        CASE WHEN db_key % 6 = 5 THEN concat(url_encode(replace(db_url, 's3://data', 'S3://Data')), '.toml') END,
        CASE WHEN db_key % 10 = 1 THEN concat('README-', CAST(db_key AS VARCHAR), '.md') END,
        CASE WHEN db_key % 10 = 2 THEN concat('s3%FF', CAST(db_key AS VARCHAR), '.toml') END,
        CASE WHEN db_key % 10 = 3 THEN concat(url_encode(replace(db_url, 's3:', 'ftp:')), '.toml') END], lambda x: x IS NOT NULL)) AS file_name FROM fx_database""",
    "fx_entry": """SELECT file_name, size, decoded, CASE WHEN decoded LIKE 'ftp%' THEN 'unsupported URL scheme ftp' WHEN decoded IS NULL THEN 'not a registry file' END AS reject_reason,
        CASE WHEN decoded NOT LIKE 'ftp%' THEN rtrim(replace(decoded, 'S3://Data', 's3://data'), '/') END AS url
      FROM (SELECT *, CASE WHEN file_name LIKE '%.toml' AND file_name NOT LIKE '%\\%FF%' ESCAPE '\\' THEN url_decode(left(file_name, length(file_name) - 5)) END AS decoded FROM fx_reg)""",
    "fx_group": """SELECT *, decoded <> url AS is_alias, first_value(file_name) OVER (PARTITION BY url ORDER BY decoded <> url, file_name) AS winner FROM fx_entry WHERE url IS NOT NULL""",
}


@query(
    "src4_registry_listing",
    "SELECT file_name, size = 0 AS defaults_only, decoded, url, reject_reason FROM fx_entry",
    REGISTRY_VIEWS,
)
def src4(fx: Fixtures) -> DataFrame:
    """Every registry file decoded; empty files need no read."""
    return registry.registry_entries(registry_listing(fx)).select(
        "file_name", (F.col("size") == 0).alias("defaults_only"), "decoded", "url", "reject_reason"
    )


@query(
    "ag10_registry_aliases",
    "SELECT file_name, url, is_alias, winner, file_name = winner AS wins FROM fx_group",
    REGISTRY_VIEWS,
)
def ag10(fx: Fixtures) -> DataFrame:
    """Which spelling stands for each database."""
    grouped = registry.alias_groups(registry.registry_entries(registry_listing(fx)))
    return grouped.select("file_name", "url", "is_alias", "winner", "wins")


@query(
    "src4_registry_warnings",
    """SELECT file_name AS subject, concat(file_name, ' is left out of the registry: ', reject_reason) AS message FROM fx_entry WHERE url IS NULL
    UNION ALL SELECT file_name, concat(file_name, ' is not the preferred spelling of its url') FROM fx_group WHERE is_alias
    UNION ALL SELECT file_name, concat(winner, ' stands for ', url, ', which ', file_name, ' names as well') FROM fx_group WHERE file_name <> winner""",
    REGISTRY_VIEWS,
)
def src4_warnings(fx: Fixtures) -> DataFrame:
    """Warnings of a registry read."""
    found = registry.registry_entries(registry_listing(fx))
    return registry.registry_warnings(found, registry.alias_groups(found))


def settings_documents(fx: Fixtures) -> DataFrame:
    """A settings document per database: good ones, and five kinds of bad ones."""
    key = F.col("db_key")
    text = F.concat(
        F.lit('{"services":["gc","'), F.when(key % 7 == 1, F.lit("gc")).otherwise(F.lit("mirror")),
        F.lit('"],"gc":{"wal":{"interval":"'), (key % 5).cast("string"), F.lit('m","dry_run":true}'),
        F.when(key % 11 == 2, F.lit(',"typo":1')).otherwise(F.lit("")),
        F.lit('},"compaction-workers":{"count":'),
        F.when(key % 13 == 3, F.lit('"many"')).otherwise((key % 4).cast("string")),
        F.lit("}"), F.when(key % 9 == 4, F.lit("")).otherwise(F.lit("}")),
    )
    return fx.database.select("db_key", F.when(key % 8 != 5, text).otherwise(F.lit("")).alias("document"))


DOCUMENT_VIEWS = {
    "fx_document": """SELECT db_key, db_key % 8 = 5 AS blank, db_key % 8 <> 5 AND db_key % 9 = 4 AS garbled FROM fx_database""",
    "fx_doc_violation": """SELECT db_key, '' AS field, 'is not a settings document' AS message FROM fx_document WHERE garbled
      UNION ALL SELECT db_key, 'services', 'has a repeated service' FROM fx_document WHERE NOT blank AND NOT garbled AND db_key % 7 = 1
      UNION ALL SELECT db_key, 'gc.typo', 'is not a known setting' FROM fx_document WHERE NOT blank AND NOT garbled AND db_key % 11 = 2
      UNION ALL SELECT db_key, 'gc.wal.interval', 'must be > 0' FROM fx_document WHERE NOT blank AND NOT garbled AND db_key % 5 = 0
      UNION ALL SELECT db_key, 'compaction-workers.count', 'has the wrong type' FROM fx_document WHERE NOT blank AND NOT garbled AND db_key % 13 = 3
      UNION ALL SELECT db_key, 'compaction-workers.count', 'must be >= 1' FROM fx_document WHERE NOT blank AND NOT garbled AND db_key % 13 <> 3 AND db_key % 4 = 0""",
}


@query(
    "src5_settings_documents",
    """SELECT db_key, CASE WHEN v.db_key IS NOT NULL THEN '' WHEN blank THEN NULL ELSE 'gc,mirror' END AS services,
      CASE WHEN v.db_key IS NULL AND NOT blank THEN CAST(db_key % 5 * 60 AS DOUBLE) END AS gc_wal_interval_s,
      CASE WHEN v.db_key IS NULL AND NOT blank THEN db_key % 4 END AS workers_count, v.db_key IS NOT NULL AS disabled
    FROM fx_document d LEFT JOIN (SELECT DISTINCT db_key FROM fx_doc_violation) v USING (db_key)""",
    DOCUMENT_VIEWS,
)
def src5(fx: Fixtures) -> DataFrame:
    """Overrides read from documents; an invalid one disables its database."""
    layer = settings.read_documents(settings_documents(fx), ["db_key"])
    bad = F.size("violations") > 0
    return layer.select(
        "db_key",
        F.array_join(F.when(bad, F.array().cast("array<string>")).otherwise(F.col("services")), ",").alias("services"),
        F.when(~bad, F.col("gc_wal_interval_s")).alias("gc_wal_interval_s"),
        F.when(~bad, F.col("compaction_workers_count")).alias("workers_count"),
        bad.alias("disabled"),
    )


@query("src5_document_violations", "SELECT * FROM fx_doc_violation", DOCUMENT_VIEWS)
def src5_violations(fx: Fixtures) -> DataFrame:
    """Every problem of every settings document."""
    # Written: to explode them, Spark would find them once to filter and once more to list.
    layer = settle(settings.read_documents(settings_documents(fx), ["db_key"]).select("db_key", "violations"), "violations")
    return layer.select("db_key", F.explode("violations").alias("v")).select("db_key", "v.field", "v.message")


# ------------------------------------------------------------------ settings


@query("jn3_layered_settings", "SELECT db_key, services, workers_count, gc_min_age_s, poll_s, 300.0::DOUBLE AS wal_min_age_s, true AS fence_dry_run FROM fx_settings")
def jn3(fx: Fixtures) -> DataFrame:
    """Settings of every database over three layers."""
    return resolved(fx).select(
        "db_key",
        F.array_join("services", ",").alias("services"),
        F.col("compaction_workers_count").alias("workers_count"),
        F.col("gc_manifest_min_age_s").alias("gc_min_age_s"),
        F.col("compactor_coordinator_poll_interval_s").alias("poll_s"),
        F.col("gc_wal_min_age_s").alias("wal_min_age_s"),
        F.col("gc_wal_fence_dry_run").alias("fence_dry_run"),
    )


MERGED_VIEW = {
    "fx_tuned": """SELECT o.db_key, o.target, CASE WHEN o.url IS NOT NULL THEN o.url ELSE f.url END AS url, CASE WHEN o.url IS NULL THEN f.source_prefix END AS source_prefix,
      coalesce(o.disabled, f.disabled, false) AS disabled, coalesce(o.mode, 'continuous') AS mode, coalesce(o.copy_parallelism, 8) AS copy_parallelism FROM fx_target_over o LEFT JOIN fx_target_x f USING (target)""",
    "fx_applied_tuned": """SELECT db_key, db_url, target, destination FROM fx_applied a WHERE NOT EXISTS (SELECT 1 FROM fx_tuned t WHERE t.db_key = a.db_key AND t.target = a.target)
      UNION ALL SELECT d.db_key, d.db_url, t.target, concat(t.url, CASE WHEN t.source_prefix IS NULL THEN '' ELSE substr(d.db_url, length(t.source_prefix) + 1) END) AS destination
      FROM fx_database d JOIN fx_tuned t ON t.db_key = d.db_key AND t.url IS NOT NULL AND NOT t.disabled AND (t.source_prefix IS NULL OR starts_with(d.db_url, concat(t.source_prefix, '/'))) WHERE destination <> d.db_url""",
}


@query(
    "jn4_target_layers",
    """SELECT * FROM fx_tuned UNION ALL SELECT NULL, target, url, source_prefix, disabled, 'continuous', 8 FROM fx_target_x""",
    MERGED_VIEW,
)
def jn4(fx: Fixtures) -> DataFrame:
    """Targets merged by name; rows without a database hold for all others."""
    inherited, tuned = settings.merge_targets(fx.target_with_exact, fx.target_override)
    columns = ["db_key", "target", "url", "source_prefix", "disabled", "mode", "copy_parallelism"]
    return tuned.select(columns).unionByName(
        inherited.withColumn("db_key", F.lit(None).cast("bigint")).select(columns)
    )


@query("jn2_prefix_targets", "SELECT db_key, db_url, target, destination FROM fx_applied")
def jn2(fx: Fixtures) -> DataFrame:
    """Where the fleet's targets send each database."""
    return applied(fx).select("db_key", "db_url", "target", "destination")


@query("jn2_tuned_targets", "SELECT db_key, db_url, target, destination FROM fx_applied_tuned", MERGED_VIEW)
def jn2_tuned(fx: Fixtures) -> DataFrame:
    """The same with per-database target overrides."""
    inherited, tuned = settings.merge_targets(fx.target_with_exact, fx.target_override)
    return targets.applied_targets(fx.database, inherited, tuned).select("db_key", "db_url", "target", "destination")


@query(
    "prj8_settings_violations",
    """SELECT db_key, 'layer' AS stage, 'compaction-workers.count' AS field, 'must be >= 1' AS message FROM fx_bad WHERE workers = 0
    UNION ALL SELECT db_key, 'layer', 'gc.wal.interval', 'must be > 0' FROM fx_bad WHERE interval_s = 0
    UNION ALL SELECT db_key, 'layer', 'services', 'has a repeated service' FROM fx_bad WHERE twice
    UNION ALL SELECT db_key, 'layer', 'compactor-coordinator.scheduler.include_size_threshold', 'must be a positive number' FROM fx_bad WHERE threshold = 0 OR isnan(threshold)
    UNION ALL SELECT db_key, 'resolved', 'compactor-coordinator.scheduler', 'the least number of sources is above the largest' FROM fx_bad WHERE lo > 8
    UNION ALL SELECT db_key, 'target', 'copy_parallelism', 'must be >= 1' FROM fx_target_over WHERE copy_parallelism = 0
    UNION ALL SELECT db_key, 'resolved target', 'url', 'is missing on an enabled target' FROM fx_tuned WHERE url IS NULL AND NOT disabled""",
    {
        **MERGED_VIEW,
        "fx_bad": """SELECT c_custkey AS db_key, c_custkey % 4 AS workers, c_custkey % 7 * 10 AS interval_s, c_custkey % 5 = 2 AS twice, CASE WHEN c_custkey % 13 = 1 THEN 'nan'::DOUBLE ELSE c_nationkey % 6 END AS threshold, c_nationkey AS lo FROM customer""",
    },
)
def prj8(fx: Fixtures) -> DataFrame:
    """Every broken rule of a flawed settings layer, before and after merging."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    layer = fx.table("customer").select(
        key.alias("db_key"),
        (key % 4).alias("compaction_workers_count"),
        (key % 7 * 10).cast("double").alias("gc_wal_interval_s"),
        F.when(key % 5 == 2, F.array(F.lit("gc"), F.lit("gc"))).alias("services"),
        F.when(key % 13 == 1, F.lit(float("nan"))).otherwise(nation % 6).cast("float")
        .alias("compactor_coordinator_scheduler_include_size_threshold"),
        F.when(nation > 0, nation).cast("bigint").alias("compactor_coordinator_scheduler_min_compaction_sources"),
    )
    _, tuned = settings.merge_targets(fx.target_with_exact, fx.target_override)
    stages = {
        "layer": settings.layer_violations(layer, ["db_key"]),
        "resolved": settings.resolved_violations(settings.resolve(fx.database, layer), ["db_key"]),
        "target": settings.target_violations(fx.target_override, ["db_key"]),
        "resolved target": settings.resolved_target_violations(tuned, ["db_key"]),
    }
    out = None
    for stage, found in stages.items():
        found = found.select("db_key", F.lit(stage).alias("stage"), "field", "message")
        out = found if out is None else out.unionByName(found)
    return out


# ------------------------------------------------------------------ liveness


@query("ag1_youngest_heartbeat", "SELECT node_id, location, age_us AS age_micros FROM fx_node")
def ag1(fx: Fixtures) -> DataFrame:
    """The youngest heartbeat of every node."""
    return liveness.youngest_per_node(entries(fx)).select("node_id", "location", "age_micros")


@query(
    "ag4_task_summary",
    """SELECT node_id, service, letter, count(state) FILTER (WHERE state = 'running') AS running, count(state) FILTER (WHERE state = 'backoff') AS backoff
    FROM (SELECT node_id, service, letters AS letter, NULL AS state FROM fx_node WHERE service IS NOT NULL
      UNION ALL SELECT concat('node-', CAST(user_id AS VARCHAR)), CASE event_type WHEN 'click' THEN 'gc' WHEN 'view' THEN 'compactor-coordinator' ELSE 'mirror' END, CASE event_type WHEN 'click' THEN 'g' WHEN 'view' THEN 'c' ELSE 'm' END, CASE WHEN value > 10 THEN 'running' WHEN value > 2 THEN 'backoff' ELSE 'done' END FROM events)
    GROUP BY node_id, service, letter""",
)
def ag4(fx: Fixtures) -> DataFrame:
    """Running and waiting tasks per node and service, with events as tasks."""
    kind = F.col("event_type")
    tasks = fx.table("events").select(
        F.concat(F.lit("node-"), F.col("user_id").cast("string")).alias("node_id"),
        F.when(kind == "click", "gc").when(kind == "view", "compactor-coordinator").otherwise("mirror").alias("service"),
        F.when(F.col("value") > 10, "running").when(F.col("value") > 2, "backoff").otherwise("done").alias("state"),
    )
    return liveness.task_summary(liveness.offers(liveness.youngest_per_node(entries(fx))), tasks)


@query(
    "sm7_stale_heartbeats",
    f"""SELECT h.node_id, h.location, CASE WHEN h.location <> n.location THEN 'replaced' ELSE 'long dead' END AS reason FROM fx_heartbeat h JOIN fx_node n USING (node_id)
    WHERE h.location <> n.location OR epoch_us(TIMESTAMP '{HEARTBEAT_NOW}') - epoch_us(h.last_modified) >= {HEARTBEAT_TIMEOUT}0000000""",
)
def sm7(fx: Fixtures) -> DataFrame:
    """Heartbeat objects to delete: replaced names and long-dead nodes."""
    current = liveness.youngest_per_node(entries(fx)).select("node_id", "location")
    return liveness.stale_heartbeats(entries(fx), current, HEARTBEAT_TIMEOUT)


# ----------------------------------------------------------------- placement

FOLD = "lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616"
PLACEMENT_VIEWS = {
    "fx_wanted": """SELECT db_url, service, NULL AS target, CASE WHEN service = 'compaction-workers' THEN workers_count ELSE 1 END AS k
      FROM (SELECT d.db_url, s.workers_count, unnest(string_split(s.services, ',')) AS service FROM fx_settings s JOIN fx_database d USING (db_key)) WHERE service NOT IN ('mirror', '')
      UNION ALL SELECT a.db_url, 'mirror', a.target, 1 FROM fx_applied a JOIN fx_settings s USING (db_key) WHERE contains(s.services, 'mirror')""",
    "fx_scored": f"""SELECT w.db_url, w.service, w.target, w.k, n.node_id, n.kind,
        list_reduce(list_prepend(w.state, list_transform(string_split(n.node_id, ''), lambda c: CAST(ord(c) AS UHUGEINT))), {FOLD}) AS score
      FROM (SELECT *, list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), list_append({byte_list("db_url", "concat(service)")}, CAST(0 AS UHUGEINT))), {FOLD}) AS plain,
          CASE WHEN target IS NULL THEN plain ELSE list_reduce(list_prepend(plain, list_append(list_transform(string_split(target, ''), lambda c: CAST(ord(c) AS UHUGEINT)), CAST(0 AS UHUGEINT))), {FOLD}) END AS state FROM fx_wanted) w
      JOIN (SELECT node_id, service, age_us < {HEARTBEAT_TIMEOUT}000000 AS kind FROM fx_node) n ON n.service = w.service""",
    "fx_ranked": """SELECT *, row_number() OVER (PARTITION BY db_url, service, target ORDER BY score DESC, node_id) AS rank FROM fx_scored WHERE kind""",
    "fx_owned": "SELECT db_url, service, target, k, node_id, rank, score FROM fx_ranked WHERE rank <= k",
}


def hex_sql(column: str) -> str:
    return f"lpad(lower(to_hex(CAST({column} AS UBIGINT))), 16, '0')"


def ranked(fx: Fixtures) -> DataFrame:
    return placement.rank_nodes(wanted(fx), live(fx))


@query(
    "jn1_service_offers",
    """SELECT s.db_url, s.service, count(n.node_id) AS n_candidates, min(n.node_id) AS first_candidate
    FROM (SELECT DISTINCT db_url, service FROM fx_wanted) s LEFT JOIN fx_live n ON n.service = s.service GROUP BY s.db_url, s.service""",
    PLACEMENT_VIEWS,
)
def jn1(fx: Fixtures) -> DataFrame:
    """How many live nodes offer what each database needs."""
    return liveness.candidate_counts(wanted(fx).select("db_url", "service").distinct(), live(fx))


@query(
    "jn15_candidate_scores",
    f"""SELECT db_url, service, target, count(*) AS n_candidates, {hex_sql('max(score)')} AS best, {hex_sql('min(score)')} AS worst FROM fx_ranked GROUP BY db_url, service, target""",
    PLACEMENT_VIEWS,
)
def jn15(fx: Fixtures) -> DataFrame:
    """How many candidates each assignment has, and their highest and lowest scores."""
    tallied = placement.tally_nodes(wanted(fx).drop("k"), live(fx))
    return tallied.filter("n_candidates > 0").select("db_url", "service", "target", "n_candidates", "best", "worst")


@query(
    "wn1_candidate_ranking",
    """SELECT db_url, service, target, string_agg(node_id, ',' ORDER BY rank) AS ranking FROM fx_ranked GROUP BY db_url, service, target""",
    PLACEMENT_VIEWS,
)
def wn1(fx: Fixtures) -> DataFrame:
    """All candidates of each assignment, best first."""
    everyone = placement.rank_all(wanted(fx).drop("k"), live(fx), separator=",")
    return everyone.filter("ranking IS NOT NULL").select("db_url", "service", "target", "ranking")


@query(
    "wn1_successors",
    f"""SELECT db_url, service, target, node_id, rank - k AS turn, {hex_sql('score')} AS score FROM fx_ranked WHERE rank > k AND rank <= k + 3""",
    PLACEMENT_VIEWS,
)
def wn1_successors(fx: Fixtures) -> DataFrame:
    """The three nodes that take over next, should owners fail: a ranking that ends where it is asked to."""
    three_more = placement.rank_nodes(wanted(fx).withColumn("own", F.col("k")).withColumn("k", F.col("k") + 3), live(fx))
    return placement.owner_rows(three_more).filter("rank > own").select(
        "db_url", "service", "target", "node_id", (F.col("rank") - F.col("own")).alias("turn"), "score"
    )


@query(
    "wn2_owners",
    f"SELECT db_url, service, target, k, node_id, rank, {hex_sql('score')} AS score FROM fx_owned",
    PLACEMENT_VIEWS,
)
def wn2(fx: Fixtures) -> DataFrame:
    """The owners of every assignment: top k, with k varying by database."""
    return placement.owner_rows(ranked(fx))


@query(
    "wn3_mirror_owner",
    """SELECT w.db_url, w.target, o.node_id AS owner FROM fx_wanted w LEFT JOIN fx_owned o ON o.db_url = w.db_url AND o.target = w.target AND o.service = 'mirror' WHERE w.service = 'mirror'""",
    PLACEMENT_VIEWS,
)
def wn3(fx: Fixtures) -> DataFrame:
    """The one owner of every (database, mirror target)."""
    mirrors = wanted(fx).filter(F.col("service") == "mirror")
    return placement.rank_nodes(mirrors, live(fx)).select(
        "db_url", "target", F.try_element_at("owners", F.lit(1))["node_id"].alias("owner")
    )


@query(
    "ag11_ownership_balance",
    "SELECT n.node_id, count(o.node_id) AS owned FROM fx_live n LEFT JOIN fx_owned o USING (node_id) GROUP BY n.node_id",
    PLACEMENT_VIEWS,
)
def ag11(fx: Fixtures) -> DataFrame:
    """How many assignments every live node owns."""
    return placement.balance(ranked(fx), live(fx))


@query(
    "ag7_unoffered_services",
    "SELECT DISTINCT service FROM fx_wanted WHERE service NOT IN (SELECT service FROM fx_live WHERE service NOT IN ('gc', 'mirror') AND service IS NOT NULL)",
    PLACEMENT_VIEWS,
)
def ag7(fx: Fixtures) -> DataFrame:
    """Needed services nobody offers, after the gc and mirror nodes went away."""
    left = live(fx).withColumn("services", F.array_except("services", F.array(F.lit("gc"), F.lit("mirror"))))
    return status.unoffered_services(wanted(fx), left)


@query(
    "jb7_churn_report",
    """SELECT db_url, service, target, string_agg(node_id, ',' ORDER BY node_id) FILTER (WHERE rank <= k AND after > k) AS lost, string_agg(node_id, ',' ORDER BY node_id) FILTER (WHERE after <= k AND rank > k) AS gained, true AS explained
    FROM (SELECT *, CASE WHEN node_id = (SELECT node_id FROM fx_busiest) THEN 999999 ELSE row_number() OVER (PARTITION BY db_url, service, target ORDER BY node_id = (SELECT node_id FROM fx_busiest), rank) END AS after FROM fx_ranked)
    GROUP BY db_url, service, target HAVING count(*) FILTER (WHERE (rank <= k) <> (after <= k)) > 0""",
    {**PLACEMENT_VIEWS, "fx_busiest": "SELECT node_id FROM fx_owned GROUP BY node_id ORDER BY count(*) DESC, node_id DESC LIMIT 1"},
)
def jb7(fx: Fixtures) -> DataFrame:
    """What moves when the busiest node leaves; only its own assignments may."""
    nodes, before = live(fx), ranked(fx)
    load = F.struct("owned", "node_id")
    last = placement.balance(before, nodes).agg(F.max_by("node_id", load).alias("m")).scalar()
    after = placement.rank_nodes(wanted(fx), nodes.filter(F.col("node_id") != last))
    moved = placement.ownership_changes(before, after)
    text = {c: F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c) for c in ("lost", "gained")}
    return moved.select(
        "db_url", "service", "target", text["lost"], text["gained"],
        F.array_contains("lost", last).alias("explained"),
    )


@query(
    "sm8_handoff_events",
    """SELECT db_url, service, target, string_agg(node_id, ',' ORDER BY node_id) FILTER (WHERE early) AS lost, string_agg(node_id, ',' ORDER BY node_id) FILTER (WHERE late) AS gained
    FROM (SELECT db_url, service, target, node_id, before <= k AS early, after <= k AS late FROM
      (SELECT *, CASE WHEN a THEN row_number() OVER (PARTITION BY db_url, service, target ORDER BY NOT a, score DESC, node_id) ELSE 999999 END AS before, CASE WHEN b THEN row_number() OVER (PARTITION BY db_url, service, target ORDER BY NOT b, score DESC, node_id) ELSE 999999 END AS after
       FROM (SELECT s.*, epoch_us(TIMESTAMP '2024-01-30 15:00:00') - epoch_us(n.last_modified) < 18000000000 AS a, kind AS b FROM fx_scored s JOIN fx_node n USING (node_id))))
    WHERE early <> late GROUP BY db_url, service, target""",
    PLACEMENT_VIEWS,
)
def sm8(fx: Fixtures) -> DataFrame:
    """Ownership changes between an earlier, stricter view of liveness and now."""
    youngest = liveness.youngest_per_node(entries(fx))
    earlier = youngest.filter(
        F.unix_micros(F.lit("2024-01-30 15:00:00").cast("timestamp"))
        - F.unix_micros(F.col("last_modified").cast("timestamp")) < F.lit(18_000_000_000)
    )
    before, after = placement.rank_nodes(wanted(fx), earlier), ranked(fx)
    moved = placement.ownership_changes(before, after)
    text = {c: F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c) for c in ("lost", "gained")}
    return moved.select("db_url", "service", "target", text["lost"], text["gained"])


@query(
    "st3_self_inclusion",
    f"SELECT node_id AS viewer, node_id, coalesce(service, '') AS services FROM fx_node WHERE age_us >= {HEARTBEAT_TIMEOUT}000000",
)
def st3(fx: Fixtures) -> DataFrame:
    """What each node adds to the shared live view: itself, if it looks dead."""
    everyone = liveness.youngest_per_node(entries(fx))
    return with_self(live(fx), everyone).select("viewer", "node_id", F.array_join("services", ",").alias("services"))


@query(
    "jb8_coverage_audit",
    """SELECT w.service, w.k, live_claims, dead_claims, count(*) AS assignments FROM
      (SELECT w.db_url, w.service, w.target, w.k, count(s.node_id) FILTER (WHERE s.kind AND ahead < w.k) AS live_claims, count(s.node_id) FILTER (WHERE NOT s.kind AND ahead < w.k) AS dead_claims
       FROM fx_wanted w LEFT JOIN (SELECT *, coalesce(sum(CAST(kind AS INT)) OVER (PARTITION BY db_url, service, target ORDER BY score DESC, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM fx_scored) s
         ON s.db_url = w.db_url AND s.service = w.service AND s.target IS NOT DISTINCT FROM w.target GROUP BY w.db_url, w.service, w.target, w.k) w
    GROUP BY w.service, w.k, live_claims, dead_claims""",
    PLACEMENT_VIEWS,
)
def jb8(fx: Fixtures) -> DataFrame:
    """How many live and dead-looking nodes claim each assignment."""
    everyone = liveness.youngest_per_node(entries(fx))
    nodes = live(fx)
    dead = everyone.join(nodes.select("node_id"), "node_id", "left_anti")
    return audits.ownership_coverage(wanted(fx), nodes, dead).groupBy(
        "service", "k", "live_claims", "dead_claims"
    ).agg(F.count(F.lit(1)).alias("assignments"))


@query(
    "jn13_reconcile",
    """SELECT db_url, service, target, CASE WHEN c_custkey % 5 = 0 THEN 'start' WHEN NOT owned THEN 'stop' WHEN c_custkey % 7 = 0 THEN 'restart' ELSE 'keep' END AS action
    FROM (SELECT c.db_key AS c_custkey, w.db_url, w.service, w.target, true AS owned FROM fx_wanted w JOIN fx_database c USING (db_url)
      UNION ALL SELECT db_key, db_url, 'retired', NULL, false FROM fx_database WHERE db_key % 5 <> 0)""",
    PLACEMENT_VIEWS,
)
def jn13(fx: Fixtures) -> DataFrame:
    """What to start, stop, restart or keep, against a drifted running set."""
    owned = wanted(fx).select("db_url", "service", "target", F.col("k").alias("fingerprint"))
    key = F.regexp_extract("db_url", "db([0-9]+)$", 1).cast("bigint")
    extra = fx.database.select(
        "db_url", F.lit("retired").alias("service"), F.lit(None).cast("string").alias("target"),
        F.lit(0).cast("bigint").alias("fingerprint"),
    )
    running = owned.unionByName(extra).filter(key % 5 != 0).withColumn(
        "fingerprint", F.when(key % 7 == 0, F.col("fingerprint") + 100).otherwise(F.col("fingerprint"))
    )
    return reconcile(owned, running)


# -------------------------------------------------------------------- status


@query(
    "ag6_destination_collisions",
    """SELECT destination, concat(db_url, ' by target ', target) AS source, n_sources FROM (SELECT *, count(*) OVER (PARTITION BY destination) AS n_sources FROM fx_applied) WHERE n_sources > 1""",
)
def ag6(fx: Fixtures) -> DataFrame:
    """Sources that share a destination."""
    return targets.collisions(applied(fx))


@query(
    "jn12_registered_destinations",
    "SELECT DISTINCT destination FROM fx_applied WHERE destination IN (SELECT db_url FROM fx_database)",
)
def jn12(fx: Fixtures) -> DataFrame:
    """Mirror destinations that are registered databases themselves."""
    return targets.registered_destinations(applied(fx), fx.database)


@query(
    "jb1_unmirrored_databases",
    """SELECT d.db_key, d.db_url FROM fx_database d JOIN fx_settings s USING (db_key) WHERE contains(s.services, 'mirror') AND NOT EXISTS (SELECT 1 FROM fx_target t WHERE NOT t.disabled AND starts_with(d.db_url, concat(t.source_prefix, '/')))""",
)
def jb1_unmirrored(fx: Fixtures) -> DataFrame:
    """Databases that want mirroring and that no prefix target covers."""
    inherited, _ = settings.merge_targets(fx.target, fx.target_override)
    mirroring = resolved(fx).filter(F.array_contains("services", "mirror")).select("db_key", "db_url")
    return targets.unmirrored(mirroring, targets.applied_targets(fx.database, inherited))


@query(
    "jb1_status_nodes",
    f"SELECT node_id, age_us < {HEARTBEAT_TIMEOUT}000000 AS live, CAST(floor(age_us / 1000000) AS BIGINT) AS heartbeat_age_s, coalesce(service, '') AS services FROM fx_node",
)
def jb1_nodes(fx: Fixtures) -> DataFrame:
    """Status: all nodes, dead and alive."""
    nodes = status.node_status(entries(fx), HEARTBEAT_TIMEOUT)
    return nodes.select("node_id", "live", "heartbeat_age_s", F.array_join("services", ",").alias("services"))


@query(
    "jb1_status_placements",
    """SELECT w.db_url, w.service, w.target, coalesce(string_agg(o.node_id, ',' ORDER BY o.rank), '') AS nodes
    FROM fx_wanted w LEFT JOIN fx_owned o ON o.db_url = w.db_url AND o.service = w.service AND o.target IS NOT DISTINCT FROM w.target GROUP BY w.db_url, w.service, w.target""",
    PLACEMENT_VIEWS,
)
def jb1_placements(fx: Fixtures) -> DataFrame:
    """Status: owners of every database's services."""
    report = status.fleet_status(entries(fx), fx.database, resolved(fx), applied(fx), HEARTBEAT_TIMEOUT)
    return report.placements.select(
        "db_url", "service", "target",
        F.array_join(F.transform("owners", lambda o: o["node_id"]), ",").alias("nodes"),
    )


WARNING_VIEWS = {
    **PLACEMENT_VIEWS,
    "fx_used": "SELECT a.* FROM fx_applied a JOIN fx_settings s USING (db_key) WHERE contains(s.services, 'mirror')",
    "fx_shared": "SELECT destination, count(*) AS n FROM fx_used GROUP BY destination HAVING count(*) > 1",
    "fx_warning": """SELECT 'collision' AS kind, u.destination AS subject, concat(u.db_url, ' by target ', u.target, ' shares the destination ', u.destination, ', one of ', CAST(s.n AS VARCHAR)) AS message FROM fx_used u JOIN fx_shared s USING (destination)
      UNION ALL SELECT 'unmirrored', d.db_url, concat(d.db_url, ' asks for a mirror, but none of the targets applies to it') FROM fx_database d JOIN fx_settings s USING (db_key) WHERE contains(s.services, 'mirror') AND db_key NOT IN (SELECT db_key FROM fx_applied)
      UNION ALL SELECT DISTINCT 'registered destination', destination, concat('the mirror destination ', destination, ' is registered as a database of its own') FROM fx_used WHERE destination IN (SELECT db_url FROM fx_database)
      UNION ALL SELECT DISTINCT 'unoffered', service, concat('nobody alive runs ', service) FROM fx_wanted WHERE service NOT IN (SELECT service FROM fx_live WHERE service IS NOT NULL)""",
}


@query("so3_ordered_warnings", "SELECT kind, subject, message FROM fx_warning ORDER BY message", WARNING_VIEWS)
def so3(fx: Fixtures) -> DataFrame:
    """Status: every warning, sorted by its text."""
    report = status.fleet_status(entries(fx), fx.database, resolved(fx), applied(fx), HEARTBEAT_TIMEOUT)
    return report.warnings


@query(
    "sm3_last_good_settings",
    """SELECT user_id, max(event_id) AS latest_version, max(event_id) FILTER (WHERE value >= 5) AS used_version, max_by(event_type, event_id) FILTER (WHERE value >= 5) AS payload, used_version IS NULL AS disabled,
      CASE WHEN used_version IS NULL THEN 'no valid settings yet, so the database is off' WHEN used_version < latest_version THEN 'newest settings invalid, an older version is in force' END AS warning FROM events GROUP BY user_id""",
)
def sm3(fx: Fixtures) -> DataFrame:
    """The settings version in force per user, with events as versions."""
    versions = fx.table("events").select(
        "user_id", F.col("event_id").alias("version"), (F.col("value") >= 5).alias("valid"),
        F.col("event_type").alias("payload"),
    )
    return settings.last_good(versions, ["user_id"])


@query(
    "snk4_delete_plan",
    f"""SELECT h.location AS path, false AS deleted, NULL AS error FROM fx_heartbeat h JOIN fx_node n USING (node_id)
    WHERE h.location <> n.location OR epoch_us(TIMESTAMP '{HEARTBEAT_NOW}') - epoch_us(h.last_modified) >= {HEARTBEAT_TIMEOUT}0000000""",
)
def snk4(fx: Fixtures) -> DataFrame:
    """Stale heartbeats as a dry run of their deletion."""
    from quayside.sinks.objects import delete_objects

    return delete_objects(sm7(fx).withColumnRenamed("location", "path"), dry_run=True)


