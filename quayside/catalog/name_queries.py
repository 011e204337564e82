"""Queries over names, URLs, durations, hashes and single-row rules."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.catalog.fixtures import HEARTBEAT_NOW, HEARTBEAT_TIMEOUT, MIRROR_NOW, Fixtures
from quayside.catalog.registration import query
from quayside.functions import names, predicates, urls
from quayside.functions.durations import duration_nanos
from quayside.functions.hashing import fold_batch, node_score, placement_key
from quayside.plans.audits import golden_mismatches
from quayside.plans.register import register_batch, register_written
from quayside.session import shared_dir
from quayside.sinks import conditional

SCHEME_LIST = "'s3', 's3a', 'gs', 'az', 'adl', 'azure', 'abfs', 'abfss', 'file', 'memory', 'http', 'https'"


def page_urls(fx: Fixtures) -> DataFrame:
    """Every page URL, spelled in one of eight ways that differ by page."""
    url, way = F.col("url"), F.col("page_id") % 8
    return fx.table("pages").select(
        "page_id",
        F.when(way == 1, F.upper(url))
        .when(way == 2, F.concat(url, F.lit("//")))
        .when(way == 3, F.regexp_replace(url, "^https?", "ftp"))
        .when(way == 4, F.regexp_replace(url, "^https?://", "S3://Bucket-"))
        .when(way == 5, F.concat(F.regexp_replace(url, "[?#].*", ""), F.lit("/a bä.x")))
        .when(way == 6, F.concat(F.lit("not a url "), F.col("page_id").cast("string")))
        .when(way == 7, F.regexp_replace(url, "^(https?://[^/]*)/", "$1/./x/../"))
        .otherwise(url).alias("url"),
    )


PAGE_URLS = """SELECT page_id, CASE page_id % 8
  WHEN 1 THEN upper(url) WHEN 2 THEN concat(url, '//') WHEN 3 THEN regexp_replace(url, '^https?', 'ftp')
  WHEN 4 THEN regexp_replace(url, '^https?://', 'S3://Bucket-')
  WHEN 5 THEN concat(regexp_replace(url, '[?#].*', ''), '/a bä.x')
  WHEN 6 THEN concat('not a url ', CAST(page_id AS VARCHAR))
  WHEN 7 THEN regexp_replace(url, '^(https?://[^/]*)/', '\\1/./x/../') ELSE url END AS url FROM pages"""


def canonical_sql(source: str) -> str:
    """Canonical URLs in SQL: every spelling used in the fixtures is covered."""
    return f"""SELECT *, CASE WHEN scheme = '' THEN 'invalid URL' WHEN scheme NOT IN ({SCHEME_LIST}) THEN concat('unsupported URL scheme ', scheme) END AS reason,
  CASE WHEN scheme IN ({SCHEME_LIST}) THEN rtrim(concat(scheme, '://', host, rest), '/') END AS canonical
  FROM (SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
    replace(replace(replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$', 1), ' ', '%20'), 'ä', '%C3%A4'), '/./x/../', '/') AS rest FROM {source})"""


URL_VIEWS = {"fx_page_url": PAGE_URLS, "fx_canonical": canonical_sql("fx_page_url")}


@query("prj1_canonical_url", "SELECT page_id, canonical, reason FROM fx_canonical", URL_VIEWS)
def prj1(fx: Fixtures) -> DataFrame:
    """Canonical spelling of every page URL, or why it has none."""
    c = urls.canonical_url(F.col("url"))
    return page_urls(fx).select("page_id", c["url"].alias("canonical"), c["reject_reason"].alias("reason"))


@query(
    "prj2_registry_names",
    """SELECT page_id, file_name, url_decode(left(file_name, length(file_name) - 5)) AS decoded, strlen(file_name) > 900 AS too_long
    FROM (SELECT page_id, concat(url_encode(concat(url, '*~+', repeat('µ', CAST(page_id % 90 AS INT)))), '.toml') AS file_name FROM pages)""",
)
def prj2(fx: Fixtures) -> DataFrame:
    """Registry file names of all page URLs, decoded back."""
    url = F.concat("url", F.lit("*~+"), F.repeat(F.lit("µ"), (F.col("page_id") % 90).cast("int")))
    named = fx.table("pages").select("page_id", names.registry_name(url).alias("file_name"))
    return named.select(
        "page_id", "file_name", names.registry_url(F.col("file_name")).alias("decoded"),
        (F.octet_length("file_name") > names.MAX_REGISTRY_NAME).alias("too_long"),
    )


@query(
    "prj3_heartbeat_names",
    """SELECT event_id, CASE WHEN ok THEN node END AS node_id, CASE WHEN ok THEN array_to_string(list_filter([
      CASE WHEN contains(letters, 'g') THEN 'gc' END, CASE WHEN contains(letters, 'c') THEN 'compactor-coordinator' END,
      CASE WHEN contains(letters, 'w') THEN 'compaction-workers' END, CASE WHEN contains(letters, 'm') THEN 'mirror' END], lambda x: x IS NOT NULL), ',') END AS services,
      CASE WHEN ok THEN concat(node, '.', array_to_string(list_sort(list_distinct(list_filter(string_split(letters, ''), lambda x: x IN ('g', 'c', 'w', 'm')))), ''), '.json') END AS encoded
    FROM (SELECT *, regexp_extract(name, '^(.+)\\.([^.]*)\\.json$', 1) AS node, regexp_extract(name, '^(.+)\\.([^.]*)\\.json$', 2) AS letters, regexp_matches(name, '^(.+)\\.([^.]*)\\.json$') AS ok
      FROM (SELECT event_id, concat(CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('n', CAST(user_id AS VARCHAR)) END, CASE WHEN event_id % 7 = 0 THEN '.b' ELSE '' END, '.',
        CASE event_type WHEN 'click' THEN 'wgcm' WHEN 'view' THEN 'xg' WHEN 'purchase' THEN '' WHEN 'signup' THEN 'mz' ELSE 'wc' END,
        CASE WHEN event_id % 13 = 0 THEN '.txt' ELSE '.json' END) AS name FROM events))""",
)
def prj3(fx: Fixtures) -> DataFrame:
    """Node and services from a heartbeat name per event, encoded again."""
    kind, key = F.col("event_type"), F.col("event_id")
    letters = (
        F.when(kind == "click", "wgcm").when(kind == "view", "xg").when(kind == "purchase", "")
        .when(kind == "signup", "mz").otherwise("wc")
    )
    name = F.concat(
        F.when(key % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("n"), F.col("user_id").cast("string"))),
        F.when(key % 7 == 0, F.lit(".b")).otherwise(F.lit("")), F.lit("."), letters,
        F.when(key % 13 == 0, F.lit(".txt")).otherwise(F.lit(".json")),
    )
    p = fx.table("events").select("event_id", names.heartbeat_parts(name).alias("p"))
    return p.select(
        "event_id",
        F.col("p.node_id").alias("node_id"),
        F.array_join("p.services", ",").alias("services"),
        names.heartbeat_name(F.col("p.node_id"), F.col("p.services")).alias("encoded"),
    )


def object_paths(fx: Fixtures) -> DataFrame:
    key = F.col("l_orderkey").cast("string")
    way = F.col("l_linenumber") * 3 + F.col("l_suppkey") % 3
    path = (
        F.when(way % 8 == 0, F.concat(F.lit("db/manifest/"), F.lpad(key, 20, "0"), F.lit(".manifest")))
        .when(way % 8 == 1, F.concat(F.lit("db/wal/"), key, F.lit(".sst")))
        .when(way % 8 == 2, F.concat(F.lit("db/compacted/01J"), F.lpad(key, 23, "Z"), F.lit(".sst")))
        .when(way % 8 == 3, F.concat(F.lit("db/compacted/"), key, F.lit(".sst")))
        .when(way % 8 == 4, F.concat(F.lit("db/manifest/"), key, F.lit(".sst")))
        .when(way % 8 == 5, F.concat(F.lit("db/wal/1844674407370"), F.lpad(key, 7, "9"), F.lit(".sst")))
        .when(way % 8 == 6, F.concat(F.lit("db/other/"), key, F.lit(".sst")))
        .otherwise(F.concat(F.lit("db/wal/18446744073709551"), F.lpad(key, 3, "6"), F.lit(".sst")))
    )
    return fx.table("lineitem").select(path.alias("path")).distinct()


OBJECT_PATHS = """SELECT DISTINCT CASE (l_linenumber * 3 + l_suppkey % 3) % 8
  WHEN 0 THEN concat('db/manifest/', lpad(CAST(l_orderkey AS VARCHAR), 20, '0'), '.manifest')
  WHEN 1 THEN concat('db/wal/', CAST(l_orderkey AS VARCHAR), '.sst')
  WHEN 2 THEN concat('db/compacted/01J', lpad(CAST(l_orderkey AS VARCHAR), 23, 'Z'), '.sst')
  WHEN 3 THEN concat('db/compacted/', CAST(l_orderkey AS VARCHAR), '.sst')
  WHEN 4 THEN concat('db/manifest/', CAST(l_orderkey AS VARCHAR), '.sst')
  WHEN 5 THEN concat('db/wal/1844674407370', lpad(CAST(l_orderkey AS VARCHAR), 7, '9'), '.sst')
  WHEN 6 THEN concat('db/other/', CAST(l_orderkey AS VARCHAR), '.sst')
  ELSE concat('db/wal/18446744073709551', lpad(CAST(l_orderkey AS VARCHAR), 3, '6'), '.sst') END AS path FROM lineitem"""


@query(
    "prj4_object_classes",
    """SELECT path, CASE WHEN n IS NOT NULL AND n <= 18446744073709551615 THEN kind WHEN ulid <> '' THEN 'compacted' END AS kind,
      CASE WHEN n <= 18446744073709551615 THEN CAST(n AS VARCHAR) END AS id, nullif(ulid, '') AS ulid
    FROM (SELECT path, TRY_CAST(nullif(regexp_extract(path, '/(?:manifest/([0-9]+)\\.manifest|wal/([0-9]+)\\.sst)$', CASE WHEN path LIKE '%.manifest' THEN 1 ELSE 2 END), '') AS HUGEINT) AS n,
      split_part(path, '/', 2) AS kind, regexp_extract(path, '/compacted/([A-Za-z0-9]{26})\\.sst$', 1) AS ulid FROM fx_path)""".replace(
        "regexp_extract(path, '/(?:manifest/([0-9]+)\\.manifest|wal/([0-9]+)\\.sst)$', CASE WHEN path LIKE '%.manifest' THEN 1 ELSE 2 END)",
        "concat(regexp_extract(path, '/manifest/([0-9]+)\\.manifest$', 1), regexp_extract(path, '/wal/([0-9]+)\\.sst$', 1))",
    ),
    {"fx_path": OBJECT_PATHS},
)
def prj4(fx: Fixtures) -> DataFrame:
    """Kind and id of every object path; NULL for names that are not objects."""
    c = names.object_class(F.col("path"))
    return object_paths(fx).select(
        "path", c["kind"].alias("kind"), c["id"].cast("string").alias("id"), c["ulid"].alias("ulid")
    )


@query(
    "prj5_age_and_liveness",
    f"""SELECT event_id, CAST(floor(age / 1000000) AS BIGINT) AS age_s, age < {HEARTBEAT_TIMEOUT}000000 AS live
    FROM (SELECT event_id, greatest(0, epoch_us(TIMESTAMP '{HEARTBEAT_NOW}') - epoch_us(ts)) AS age FROM events)""",
)
def prj5(fx: Fixtures) -> DataFrame:
    """Age and liveness if each event were a heartbeat; the future has age zero."""
    age = predicates.age_micros(fx.heartbeat_now, F.col("ts"))
    return fx.table("events").select(
        "event_id", predicates.age_seconds(fx.heartbeat_now, F.col("ts")).alias("age_s"),
        predicates.is_live(age, HEARTBEAT_TIMEOUT).alias("live"),
    )


@query(
    "prj6_live_checkpoints",
    f"""SELECT db_key, count(*) FILTER (WHERE expire_time IS NULL OR expire_time > TIMESTAMP '{MIRROR_NOW}') AS live, count(*) AS total FROM fx_checkpoint GROUP BY db_key""",
)
def prj6(fx: Fixtures) -> DataFrame:
    """Live checkpoint entries per database."""
    live = predicates.checkpoint_live(F.col("expire_time"), fx.mirror_now)
    return fx.checkpoint.groupBy("db_key").agg(
        F.count_if(live).alias("live"), F.count(F.lit(1)).alias("total")
    )


@query(
    "prj7_identifiers",
    """SELECT p_partkey, name, regexp_full_match(name, '[A-Za-z0-9_-]{1,128}') AS valid
    FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN concat(p_brand, chr(10)) ELSE repeat(p_type, CAST(p_size AS INT)) END AS name FROM part)""",
)
def prj7(fx: Fixtures) -> DataFrame:
    """Which part names would do as node or target names."""
    way = F.col("p_partkey") % 4
    name = (
        F.when(way == 0, F.col("p_name")).when(way == 1, F.replace("p_name", F.lit(" "), F.lit("-")))
        .when(way == 2, F.concat("p_brand", F.lit("\n"))).otherwise(F.repeat("p_type", F.col("p_size")))
    )
    return fx.table("part").select("p_partkey", name.alias("name")).withColumn(
        "valid", names.valid_identifier(F.col("name"))
    )


@query(
    "prj9_source_exclusion",
    """SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN 'clone of other databases' WHEN o_orderkey % 13 = 0 THEN 'separate WAL object store' END AS reason FROM orders""",
)
def prj9(fx: Fixtures) -> DataFrame:
    """Why a source cannot be mirrored, with orders standing in for heads."""
    external = F.when(
        F.col("o_custkey") % 11 == 0, F.array(F.concat(F.lit("s3://base/"), F.col("o_custkey").cast("string")))
    ).when(F.col("o_custkey") % 11 == 1, F.array().cast("array<string>"))
    store = F.when(F.col("o_orderkey") % 13 == 0, F.lit("s3://wal"))
    return fx.table("orders").select("o_orderkey", predicates.exclusion_reason(external, store).alias("reason"))


def byte_list(*parts: str) -> str:
    """SQL for the bytes of ASCII text parts, joined by zero bytes."""
    lists = [f"list_transform(string_split({p}, ''), lambda c: CAST(ord(c) AS UHUGEINT))" for p in parts]
    joined = lists[0]
    for part in lists[1:]:
        joined = f"list_concat(list_append({joined}, CAST(0 AS UHUGEINT)), {part})"
    return joined


def fnv_sql(*parts: str) -> str:
    """SQL for the hash of ASCII text parts, as 16 hex digits."""
    return (
        f"lpad(lower(to_hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), {byte_list(*parts)}), "
        "lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS UBIGINT))), 16, '0')"
    )


SCORE_ROWS = """SELECT db_key, db_url, list_extract(['gc', 'compactor-coordinator', 'compaction-workers', 'mirror'], CAST(db_key % 4 + 1 AS INT)) AS service, concat('t', CAST(c_nationkey AS VARCHAR)) AS target, concat('node-', CAST(c_nationkey * 7 AS VARCHAR)) AS node_id FROM fx_database"""


def score_rows(fx: Fixtures) -> DataFrame:
    services = F.array(*[F.lit(s) for s in names.SERVICES])
    return fx.database.select(
        "db_key", "db_url", F.element_at(services, (F.col("db_key") % 4 + 1).cast("int")).alias("service"),
        F.concat(F.lit("t"), F.col("c_nationkey").cast("string")).alias("target"),
        F.concat(F.lit("node-"), (F.col("c_nationkey") * 7).cast("string")).alias("node_id"),
    )


@query(
    "prj10_rendezvous_scores",
    f"SELECT db_url, service, node_id, {fnv_sql('db_url', 'service', 'node_id')} AS score FROM fx_score_row",
    {"fx_score_row": SCORE_ROWS},
)
def prj10(fx: Fixtures) -> DataFrame:
    """The score of one (database, service, node) per database."""
    score = node_score(F.col("db_url"), F.col("service"), F.col("node_id"))
    return score_rows(fx).select("db_url", "service", "node_id", score.alias("score"))


@query(
    "prj11_target_scores",
    f"""SELECT db_url, target, node_id, {fnv_sql('db_url', "'mirror'", 'target', 'node_id')} AS score FROM fx_score_row""",
    {"fx_score_row": SCORE_ROWS},
)
def prj11(fx: Fixtures) -> DataFrame:
    """The score of one (database, mirror target, node) per database."""
    score = node_score(F.col("db_url"), F.lit("mirror"), F.col("node_id"), F.col("target"))
    return score_rows(fx).select("db_url", "target", "node_id", score.alias("score"))


@query(
    "prj12_durations",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS BIGINT) * 3600000000000 + (p_partkey % 60) * 60000000000
      WHEN 1 THEN (p_partkey % 1000) * 1000000 WHEN 2 THEN CAST(p_size AS BIGINT) * 86400000000000 + 7000000000 WHEN 3 THEN CAST(p_size AS BIGINT) * 604800000000000 + 2630016000000000 END AS nanos FROM part""",
)
def prj12(fx: Fixtures) -> DataFrame:
    """Duration texts in nanoseconds; texts that are no durations are NULL."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    way = key % 6
    text = (
        F.when(way == 0, F.concat(size, F.lit("h "), (key % 60).cast("string"), F.lit("m")))
        .when(way == 1, F.concat((key % 1000).cast("string"), F.lit("ms")))
        .when(way == 2, F.concat(size, F.lit(" days 7sec")))
        .when(way == 3, F.concat(size, F.lit("weeks1M")))
        .when(way == 4, F.concat(size, F.lit(" fortnights")))
        .otherwise(F.concat(size, F.lit("h and a bit")))
    )
    return fx.table("part").select("p_partkey", duration_nanos(text).alias("nanos"))


@query(
    "prj13_copy_remotes",
    """SELECT page_id, CASE WHEN scheme IN ('s3') THEN concat(':s3,env_auth:', regexp_extract(u, '^[^:]*://([^/?#]*)', 1), '/', ltrim(regexp_extract(u, '^[^:]*://[^/?#]*([^?#]*)', 1), '/'))
      WHEN scheme = 'gs' THEN concat(':gcs,env_auth:', regexp_extract(u, '^[^:]*://([^/?#]*)', 1), '/', ltrim(regexp_extract(u, '^[^:]*://[^/?#]*([^?#]*)', 1), '/'))
      WHEN scheme = 'file' THEN regexp_extract(u, '^[^:]*://([^?#]*)', 1) END AS remote,
      CASE WHEN scheme LIKE 'http%' THEN concat('no backend for scheme ', scheme) END AS error
    FROM (SELECT *, regexp_extract(u, '^([^:]*):', 1) AS scheme FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?', 's3') WHEN 2 THEN regexp_replace(url, '^https?', 'gs') ELSE regexp_replace(url, '^https?://', 'file:///') END AS u FROM pages))""",
)
def prj13(fx: Fixtures) -> DataFrame:
    """The copy tool's remote for every page URL, under four schemes."""
    way = F.col("page_id") % 4
    url = (
        F.when(way == 0, F.col("url")).when(way == 1, F.regexp_replace("url", "^https?", "s3"))
        .when(way == 2, F.regexp_replace("url", "^https?", "gs"))
        .otherwise(F.regexp_replace("url", "^https?://", "file:///"))
    )
    r = urls.copy_remote(url)
    return fx.table("pages").select("page_id", r["remote"].alias("remote"), r["error"].alias("error"))


@query(
    "prj14_settings_fingerprint",
    """SELECT o.db_key, coalesce(o.services, 'all') <> 'all' OR coalesce(o.workers_count, f.workers_count) <> f.workers_count OR coalesce(o.gc_min_age_s, f.gc_min_age_s) <> f.gc_min_age_s AS changed FROM fx_override o, fx_fleet f""",
)
def prj14(fx: Fixtures) -> DataFrame:
    """Whose settings fingerprint changes when the overrides are dropped."""
    from quayside.operators.settings import SETTINGS, resolve

    print_of = predicates.fingerprint(*[F.col(s.column) for s in SETTINGS])
    tuned = resolve(fx.database, fx.override, fx.fleet).select("db_key", print_of.alias("tuned"))
    plain = resolve(fx.database, None, fx.fleet).select("db_key", print_of.alias("plain"))
    return tuned.join(plain, "db_key").select("db_key", (F.col("tuned") != F.col("plain")).alias("changed"))


@query(
    "prj15_lag_arithmetic",
    """SELECT o_orderkey, CASE WHEN src IS NOT NULL THEN greatest(0, src - coalesce(dst, 0)) END AS behind
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS src, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey * 10 END AS dst FROM orders)""",
)
def prj15(fx: Fixtures) -> DataFrame:
    """Id differences that never go negative, with either side missing."""
    src = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey"))
    dst = F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") * 10)
    return fx.table("orders").select("o_orderkey", predicates.behind(src, dst).alias("behind"))


# ------------------------------------------------------------ registration


def register_requests(fx: Fixtures) -> DataFrame:
    """Each page asks once; spellings of one URL ask for the same database."""
    return page_urls(fx).select(F.col("page_id").alias("request_id"), "url")


def existing_files(fx: Fixtures) -> DataFrame:
    """Files of the pages of the ``en`` section exist already."""
    there = fx.table("pages").filter(F.col("url").contains("/en/"))
    return there.select(names.registry_name(urls.canonical_url(F.col("url"))["url"]).alias("file_name")).distinct()


REGISTER_VIEWS = {
    **URL_VIEWS,
    "fx_existing": "SELECT DISTINCT concat(url_encode(rtrim(url, '/')), '.toml') AS file_name FROM pages WHERE contains(url, '/en/')",
    "fx_asked": "SELECT page_id AS request_id, canonical AS url, concat(url_encode(canonical), '.toml') AS file_name, reason AS reject_reason FROM fx_canonical",
    "fx_registered": """SELECT request_id, url, CASE WHEN url IS NOT NULL THEN a.file_name END AS file_name, reject_reason,
      coalesce(url IS NOT NULL AND e.file_name IS NULL AND request_id = min(request_id) OVER (PARTITION BY a.file_name), false) AS created FROM fx_asked a LEFT JOIN fx_existing e ON e.file_name = a.file_name""",
}


@query("jb11_register_batch", "SELECT * FROM fx_registered", REGISTER_VIEWS)
def jb11(fx: Fixtures) -> DataFrame:
    """Register every page's URL as a database."""
    return register_batch(register_requests(fx), existing_files(fx))


@query("jb11_written_registry", "SELECT * FROM fx_registered", REGISTER_VIEWS)
def jb11_written(fx: Fixtures) -> DataFrame:
    """Register every page's URL in a folder of registry files, new ones written by the executors."""
    root = shared_dir(fx.spark, "registry")
    held = existing_files(fx).select(F.col("file_name").alias("object_name"), F.encode(F.lit("{}"), "UTF-8").alias("content"))
    conditional.create_objects(held, root).write.format("noop").mode("overwrite").save()
    return register_written(register_requests(fx), root)


@query(
    "snk1_create_if_absent",
    "SELECT request_id, file_name, created FROM fx_registered WHERE url IS NOT NULL",
    REGISTER_VIEWS,
)
def snk1(fx: Fixtures) -> DataFrame:
    """Which registry files a batch creates; existing ones are left alone."""
    from quayside.sinks.commit import create_if_absent

    asked = register_requests(fx).withColumn("_r", names.registered_url(F.col("url"))).select(
        "request_id", F.col("_r.file_name").alias("file_name")
    ).filter(F.col("file_name").isNotNull())
    return create_if_absent(asked, existing_files(fx), "file_name", "request_id")


@query(
    "jb9_golden_mismatches",
    f"""SELECT 'registry' AS kind, db_url AS subject, concat(url_encode(db_url), '.toml', CASE WHEN db_key % 17 = 3 THEN 'x' ELSE '' END) AS want, concat(url_encode(db_url), '.toml') AS got FROM fx_database WHERE want <> got
    UNION ALL SELECT 'wal', CAST(db_key AS VARCHAR), concat('wal/', CAST(db_key AS VARCHAR), '.sst') AS want, concat('wal/', lpad(CAST(db_key AS VARCHAR), 20, '0'), '.sst') AS got FROM fx_database WHERE want <> got AND db_key % 19 = 4
    UNION ALL SELECT 'score', concat_ws(' ', db_url, service, target, node_id), repeat('0', 16) AS want, {fnv_sql('db_url', 'service', 'target', 'node_id')} AS got FROM (SELECT *  REPLACE ('mirror' AS service) FROM fx_score_row WHERE db_key % 23 = 5)""",
    {"fx_score_row": SCORE_ROWS},
)
def jb9(fx: Fixtures) -> DataFrame:
    """Names and scores of all databases against a recording with known flaws."""
    key, url = F.col("db_key"), F.col("db_url")
    registry = fx.database.select(
        F.lit("registry").alias("kind"), url.alias("source"),
        F.concat(names.registry_name(url), F.when(key % 17 == 3, F.lit("x")).otherwise(F.lit(""))).alias("want"),
    )
    wals = fx.database.select(
        F.lit("wal").alias("kind"), key.cast("string").alias("source"),
        F.when(key % 19 == 4, F.concat(F.lit("wal/"), key.cast("string"), F.lit(".sst")))
        .otherwise(F.concat(F.lit("wal/"), F.format_string("%020d", key), F.lit(".sst"))).alias("want"),
    )
    scores = score_rows(fx).withColumn("service", F.lit("mirror"))
    recorded = recorded_scores(scores).withColumn(
        "want", F.when(key % 23 == 5, F.repeat(F.lit("0"), 16)).otherwise(F.col("want"))
    )
    return golden_mismatches(registry.unionByName(wals), recorded)


def recorded_scores(rows: DataFrame) -> DataFrame:
    """The recording: scores from the batch implementation of the hash."""
    @F.arrow_udf("string")
    def batch_score(keys: pa.Array) -> pa.Array:
        return pa.array([f"{value:016x}" for value in fold_batch(keys).tolist()], pa.string())

    key = F.concat(placement_key(F.col("db_url"), F.col("service"), F.col("target")), F.col("node_id"))
    return rows.withColumn("want", batch_score(key))
