"""Layered settings: built-in defaults, fleet policy, per-database overrides.

The catalog below lists every setting once: its column, where it sits in a
settings document, its type, its default and its validation rule. Resolution,
document reading and validation are generated from it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.durations import duration_seconds
from quayside.functions.names import SERVICES, valid_identifier
from quayside.functions.urls import canonical_url
from quayside.session import settle, spread

KIND_TYPES = {
    "flag": "boolean", "duration": "double", "count": "bigint", "ratio": "float",
    "text": "string", "services": "array<string>",
}


@dataclass(frozen=True)
class Setting:
    path: tuple[str, ...]
    kind: str
    default: object
    rule: str | None = None
    allowed: tuple[str, ...] = ()

    @property
    def column(self) -> str:
        name = "_".join(self.path).replace("-", "_")
        return name + "_s" if self.kind == "duration" else name

    @property
    def dotted(self) -> str:
        return ".".join(self.path)


# The settings, their defaults and their rules.
_GC_DIRECTORIES = ["manifest", "wal", "wal_fence", "compacted", "compactions"]
_COORDINATOR, _SCHEDULER, _WORKERS = (
    ("compactor-coordinator",), ("compactor-coordinator", "scheduler"), ("compaction-workers",),
)
_MIB = 1024 * 1024

SETTINGS: list[Setting] = [Setting(("services",), "services", SERVICES, "distinct", tuple(SERVICES))]
for _directory in _GC_DIRECTORIES:
    _at = ("gc", _directory)
    SETTINGS += [
        Setting(_at + ("enabled",), "flag", True),
        Setting(_at + ("interval",), "duration", 60.0, "> 0"),
        Setting(_at + ("min_age",), "duration", 300.0),
        Setting(_at + ("dry_run",), "flag", _directory == "wal_fence"),
    ]
SETTINGS += [
    Setting(("gc", "detach", "enabled"), "flag", True),
    Setting(("gc", "detach", "interval"), "duration", 60.0, "> 0"),
    Setting(_COORDINATOR + ("poll_interval",), "duration", 5.0, "> 0"),
    Setting(_COORDINATOR + ("manifest_update_timeout",), "duration", 300.0, "> 0"),
    Setting(_COORDINATOR + ("max_concurrent_compactions",), "count", 4, ">= 1"),
    Setting(_COORDINATOR + ("commit_compacted_interval",), "duration", 1.0, "> 0"),
    Setting(_COORDINATOR + ("worker_heartbeat_timeout",), "duration", 30.0, "> 0"),
    Setting(_SCHEDULER + ("min_compaction_sources",), "count", 4, ">= 1"),
    Setting(_SCHEDULER + ("max_compaction_sources",), "count", 8, ">= 1"),
    Setting(_SCHEDULER + ("include_size_threshold",), "ratio", 4.0, "a positive number"),
    Setting(_WORKERS + ("count",), "count", 1, ">= 1"),
    Setting(_WORKERS + ("max_concurrent_compactions",), "count", 4, ">= 1"),
    Setting(_WORKERS + ("compactions_poll_interval",), "duration", 5.0, "> 0"),
    Setting(_WORKERS + ("heartbeat_bytes",), "count", 5 * _MIB),
    Setting(_WORKERS + ("heartbeat_min_interval",), "duration", 5.0),
    Setting(_WORKERS + ("max_sst_size",), "count", 256 * _MIB, "> 0"),
    Setting(_WORKERS + ("max_fetch_tasks",), "count", 4, ">= 1"),
    Setting(_WORKERS + ("bytes_to_fetch",), "count", 2 * _MIB, "> 0"),
    Setting(_WORKERS + ("max_subcompactions",), "count", 4),
    Setting(_WORKERS + ("min_filter_keys",), "count", 1000),
    Setting(_WORKERS + ("compression_codec",), "text", None, None, ("snappy", "zlib", "lz4", "zstd")),
]

# Fleet-wide node settings (heartbeat and polling intervals).
NODE_SETTINGS = [
    Setting(("node", "heartbeat_interval"), "duration", 10.0, "> 0"),
    Setting(("node", "heartbeat_timeout"), "duration", 30.0),
    Setting(("node", "config_poll"), "duration", 60.0, "> 0"),
]

# Settings of one mirror target. ``url`` and ``source_prefix``
# are one pair and resolved apart from these.
TARGET_SETTINGS = [
    Setting(("disabled",), "flag", False),
    Setting(("mode",), "text", "continuous", None, ("continuous", "periodic")),
    Setting(("copier",), "text", "builtin", None, ("builtin", "rclone", "external")),
    Setting(("poll",), "duration", 10.0, "> 0"),
    Setting(("interval",), "duration", 86_400.0, "> 0"),
    Setting(("min_age",), "duration", 300.0, "> 0"),
    Setting(("checkpoint_lifetime",), "duration", 900.0, "> 0"),
    Setting(("copy_parallelism",), "count", 8, ">= 1"),
    Setting(("retention", "keep"), "duration", None, "> 0"),
]

_VIOLATION = "struct<field:string,message:string>"


def _default(setting: Setting) -> Column:
    return F.lit(setting.default).cast(KIND_TYPES[setting.kind])


def _layered(setting: Setting, override: DataFrame, policy: Column | None, fleet_columns: list[str]) -> Column:
    layers = []
    if setting.column in override.columns:
        layers.append(F.col(setting.column))
    if policy is not None and setting.column in fleet_columns:
        layers.append(policy[setting.column])
    layers.append(_default(setting))
    return F.coalesce(*[c.cast(KIND_TYPES[setting.kind]) for c in layers]).alias(setting.column)


def _policy(fleet: DataFrame | None) -> Column | None:
    """The fleet row as a scalar subquery: no row means NULL, two rows fail."""
    if fleet is None:
        return None
    return fleet.select(F.struct(*fleet.columns).alias("policy")).scalar()


def resolve(databases: DataFrame, overrides: DataFrame | None = None, fleet: DataFrame | None = None,
            keys: tuple[str, ...] = ("db_key",), settings: list[Setting] | None = None) -> DataFrame:
    """Every setting of every database: override, else fleet policy, else default.

    ``overrides`` and ``fleet`` hold any subset of the catalog's columns and
    NULL where they say nothing. A ``services`` list replaces the one below it
    as a whole, the empty list included.
    """
    settings = settings or SETTINGS
    fields = {s.column for s in settings}
    base = databases.select(*[c for c in databases.columns if c not in fields])
    if overrides is not None:
        known = [c for c in overrides.columns if c in fields]
        base = base.join(overrides.select(*keys, *known), list(keys), "left")
    columns = fleet.columns if fleet is not None else []
    policy = _policy(fleet)
    kept = [c for c in base.columns if c not in fields]
    return base.select(*kept, *[_layered(s, base, policy, columns) for s in settings])


def resolve_node_settings(spark, fleet: DataFrame | None) -> DataFrame:
    """The fleet-wide node settings as one row."""
    return resolve(spark.range(1).select(F.lit(0).alias("db_key")), None, fleet,
                   settings=NODE_SETTINGS).drop("db_key")


def merge_targets(fleet_targets: DataFrame, db_targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mirror targets by name: (those every database inherits, those a database tuned).

    The first is one row per fleet target with defaults filled in. The second
    has a row per (db_key, target) override, merged field by field over the
    fleet target of that name. A layer that sets either of ``url`` and
    ``source_prefix`` replaces both. Together they are the full outer merge,
    without repeating untouched fleet targets for every database.
    """
    pair = ["url", "source_prefix"]

    def padded(df: DataFrame, extra: list[str]) -> DataFrame:
        types = {s.column: KIND_TYPES[s.kind] for s in TARGET_SETTINGS} | dict.fromkeys(pair, "string")
        return df.select(
            *extra,
            *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()],
        )

    fleet = padded(fleet_targets, ["target"])
    inherited = fleet.select(
        "target", *pair, *[F.coalesce(F.col(s.column), _default(s)).alias(s.column) for s in TARGET_SETTINGS]
    )
    over = padded(db_targets, ["db_key", "target"]).alias("o")
    below = fleet.alias("f")
    sets_pair = F.col("o.url").isNotNull() | F.col("o.source_prefix").isNotNull()
    tuned = over.join(below, F.col("o.target") == F.col("f.target"), "left").select(
        F.col("o.db_key").alias("db_key"),
        F.col("o.target").alias("target"),
        *[F.when(sets_pair, F.col(f"o.{c}")).otherwise(F.col(f"f.{c}")).alias(c) for c in pair],
        *[
            F.coalesce(F.col(f"o.{s.column}"), F.col(f"f.{s.column}"), _default(s)).alias(s.column)
            for s in TARGET_SETTINGS
        ],
    )
    return inherited, tuned


# --------------------------------------------------------------- validation


def _violation(broken: Column, field: str, message: str) -> Column:
    return F.when(broken, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))


def _rule_broken(setting: Setting, value: Column) -> Column | None:
    if setting.rule == "> 0":
        return value <= 0
    if setting.rule == ">= 1":
        return value < 1
    if setting.rule == "a positive number":
        return F.isnan(value) | (value <= 0) | (value == float("inf"))
    return None


def _block_checks(df: DataFrame, settings: list[Setting], prefix: str = "") -> list[Column]:
    checks = []
    for s in settings:
        if s.column not in df.columns:
            continue
        value, field = F.col(s.column), prefix + s.dotted
        if s.rule == "distinct":
            checks.append(_violation(
                F.size(F.array_distinct(value)) < F.size(value), field, "has a repeated service"
            ))
            checks.append(_violation(
                F.exists(value, lambda v: ~v.isin(*s.allowed)), field, "has an unknown service"
            ))
        elif s.allowed:
            checks.append(_violation(~value.isin(*s.allowed), field, "has an unknown value"))
        broken = _rule_broken(s, value)
        if broken is not None:
            checks.append(_violation(broken, field, f"must be {s.rule}"))
    return checks


def _report(df: DataFrame, keys: list[str], checks: list[Column]) -> DataFrame:
    found = F.filter(F.array(*checks), lambda v: v.isNotNull())
    return df.select(*keys, F.explode(found).alias("v")).select(*keys, "v.field", "v.message")


def layer_violations(layer: DataFrame, keys: list[str]) -> DataFrame:
    """Every broken rule of a settings layer as given (``keys, field, message``)."""
    return _report(layer, keys, _block_checks(layer, SETTINGS))


def fleet_violations(fleet: DataFrame) -> DataFrame:
    """Broken rules of the fleet policy's node settings."""
    columns = {s.path[-1]: F.coalesce(F.col(s.column), _default(s)) if s.column in fleet.columns
               else _default(s) for s in NODE_SETTINGS}
    checks = _block_checks(fleet, NODE_SETTINGS)
    checks.append(_violation(
        columns["heartbeat_interval"] >= columns["heartbeat_timeout"],
        "node.heartbeat_interval", "has to stay below node.heartbeat_timeout",
    ))
    return _report(fleet, [], checks)


def resolved_violations(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Broken rules that only show once the layers are merged."""
    low = F.col("compactor_coordinator_scheduler_min_compaction_sources")
    high = F.col("compactor_coordinator_scheduler_max_compaction_sources")
    check = _violation(
        low > high, "compactor-coordinator.scheduler",
        "the least number of sources is above the largest",
    )
    return _report(resolved, keys, [check])


def target_violations(layer: DataFrame, keys: list[str]) -> DataFrame:
    """Broken rules of mirror-target rows as given."""
    checks = [_violation(
        ~valid_identifier(F.col("target")), "name", "is no name of 1 to 128 letters, digits, _ or -"
    )] + _block_checks(layer, TARGET_SETTINGS)
    return _report(layer, keys, checks)


def resolved_target_violations(targets: DataFrame, keys: list[str]) -> DataFrame:
    """An enabled target needs a usable url, and a usable prefix if it has one."""
    enabled = ~F.col("disabled")
    checks = [
        _violation(enabled & F.col("url").isNull(), "url", "is missing on an enabled target")
    ]
    for field in ("url", "source_prefix"):
        bad = canonical_url(F.col(field))["reject_reason"].isNotNull()
        checks.append(_violation(enabled & F.col(field).isNotNull() & bad, field, "is not a usable URL"))
    return _report(targets, keys, checks)


# ---------------------------------------------------------------- documents


def _tree(settings: list[Setting]) -> dict:
    tree: dict = {}
    for s in settings:
        node = tree
        for part in s.path[:-1]:
            node = node.setdefault(part, {})
        node[s.path[-1]] = s
    return tree


def _json_type(node: dict) -> str:
    parts = []
    for name, child in node.items():
        if isinstance(child, dict):
            parts.append(f"`{name}`:{_json_type(child)}")
        else:
            parts.append(f"`{name}`:{'array<string>' if child.kind == 'services' else 'string'}")
    return f"struct<{','.join(parts)}>"


def _typed(setting: Setting, text: Column) -> Column:
    if setting.kind == "services":
        return text
    if setting.kind == "duration":
        return duration_seconds(text)
    return text.try_cast(KIND_TYPES[setting.kind])


def _unknown_keys(node: dict, document: Column, path: str = "$") -> list[Column]:
    """Field names no setting has, level by level, as arrays of dotted names."""
    here = document if path == "$" else F.get_json_object(document, path)
    keys = F.coalesce(F.json_object_keys(here), F.array().cast("array<string>"))
    prefix = path.replace("$", "").replace("['", "").replace("']", ".")
    extra = F.filter(keys, lambda k: ~k.isin(*node))
    found = [F.transform(extra, lambda k: F.concat(F.lit(prefix), k))]
    for name, child in node.items():
        if isinstance(child, dict):
            found += _unknown_keys(child, document, f"{path}['{name}']")
    return found


def read_documents(documents: DataFrame, keys: list[str], column: str = "document",
                   settings: list[Setting] | None = None, ignore: tuple[str, ...] = ("mirror",)) -> DataFrame:
    """Settings documents (JSON text) as a settings layer with ``violations``.

    The schema is closed: a field the catalog does not have is a violation,
    as is a value of the wrong kind or a broken rule. Unreadable text is one
    violation. An empty or NULL document sets nothing. Top-level sections
    named in ``ignore`` are read elsewhere. Documents are dealt to tasks by their
    number first, since reading one costs far more than its bytes tell, and
    written, since a filter would move below the dealing.
    """
    settings = settings or SETTINGS
    documents = settle(spread(documents.select(*keys, column)), "documents")
    tree = _tree(settings)
    text = F.when(F.trim(F.col(column)) != "", F.col(column))
    parsed = documents.select(
        *keys,
        text.alias("_text"),
        F.from_json(text, _json_type(tree)).alias("_doc"),
        (text.isNotNull() & F.json_object_keys(text).isNull()).alias("_garbled"),
    )
    values, problems = [], []
    for s in settings:
        raw = F.col("_doc")
        for part in s.path:
            raw = raw[part]
        value = _typed(s, raw)
        values.append(value.alias(s.column))
        if s.kind != "services":
            problems.append(_violation(raw.isNotNull() & value.isNull(), s.dotted, "has the wrong type"))
    layer = parsed.select(*keys, "_text", "_garbled", *values, F.array(*problems).alias("_types"))
    known = {**tree, **dict.fromkeys(ignore, None)}
    unknown = F.transform(
        F.flatten(F.array(*_unknown_keys(known, F.col("_text")))),
        lambda name: F.struct(name.alias("field"), F.lit("is not a known setting").alias("message")),
    )
    garbled = F.array(_violation(F.col("_garbled"), "", "is not a settings document"))
    every = F.concat(garbled, unknown, "_types", F.array(*_block_checks(layer, settings)))
    violations = F.filter(every, lambda v: v.isNotNull()).cast(f"array<{_VIOLATION}>")
    return layer.withColumn("violations", violations).drop("_text", "_garbled", "_types")


def last_good(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The settings in force per key: the newest valid version wins.

    ``versions`` is (keys, version, valid, payload). If the newest version is
    invalid the last valid one stays, with a warning; a key that never had a
    valid version is disabled. Two aggregates and no window, so a key with very
    many versions is reduced before the shuffle.
    """
    grouped = versions.groupBy(*keys).agg(
        F.max("version").alias("latest_version"),
        F.max(F.when(F.col("valid"), F.struct("version", "payload"))).alias("good"),
    )
    stale = F.col("good").isNull() | (F.col("good.version") < F.col("latest_version"))
    return grouped.select(
        *keys,
        "latest_version",
        F.col("good.version").alias("used_version"),
        F.col("good.payload").alias("payload"),
        F.col("good").isNull().alias("disabled"),
        F.when(F.col("good").isNull(), F.lit("no valid settings yet, so the database is off"))
        .when(stale, F.lit("newest settings invalid, an older version is in force"))
        .alias("warning"),
    )
