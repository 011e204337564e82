"""Snapshot catalogs: manifests, the objects they reference, their closures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.names import compacted_name, wal_name
from quayside.functions.predicates import checkpoint_live
from quayside.operators.intervals import chunk_ids, chunks, merged


@dataclass(frozen=True)
class Catalog:
    """One side's decoded snapshots, of all databases together.

    ``manifests``    (db_key, manifest_id, last_modified, replay_after_wal_id,
                     next_wal_sst_id, last_l0_seq, ...)
    ``objects``      (db_key, manifest_id, kind, object_name), see :func:`manifest_objects`
    ``checkpoints``  (db_key, manifest_id, cp_id, pinned_id, create_time,
                     expire_time, ...), one row per carrying manifest
    """

    manifests: DataFrame
    objects: DataFrame
    checkpoints: DataFrame


def manifest_objects(manifests: DataFrame, keys: tuple[str, ...] = ("db_key",)) -> DataFrame:
    """The data objects each nested manifest row references, each once.

    ``l0``, every run's ``ssts``, and the same of every segment are lists of
    ``struct<ulid, wal_id>``; an entry with a WAL id is a WAL object. The WAL
    window between the replay position and the next id is open on both ends.
    A manifest is one row, so its set of names is made within the row and the
    window by chunks: the table is read once and nothing is shuffled.
    """
    ids = [*keys, "manifest_id"]
    runs = F.flatten(F.transform("runs", lambda r: r["ssts"]))
    in_segments = F.flatten(
        F.transform(
            "segments",
            lambda s: F.concat(s["l0"], F.flatten(F.transform(s["runs"], lambda r: r["ssts"]))),
        )
    )
    none = F.array().cast("array<struct<ulid:string,wal_id:bigint>>")
    views = F.concat(*[F.coalesce(part, none) for part in (F.col("l0"), runs, in_segments)])
    # A WAL object that the window holds too is left to the window.
    outside = F.filter(views, lambda v: ~F.coalesce(
        (v["wal_id"] > F.col("replay_after_wal_id")) & (v["wal_id"] < F.col("next_wal_sst_id")), F.lit(False)))
    listed = F.array_distinct(F.transform(outside, lambda v: F.coalesce(wal_name(v["wal_id"]), compacted_name(v["ulid"]))))
    # One part for what is listed and one per chunk of the window: no row holds a whole window.
    no_names = F.lit(None).cast("array<string>")
    parts = F.concat(
        F.array(F.struct(listed.alias("names"), F.lit(None).cast("bigint").alias("first"))),
        F.transform(_window_chunks(), lambda first: F.struct(no_names.alias("names"), first.alias("first"))),
    )
    cut = manifests.select(*ids, "next_wal_sst_id", F.explode(parts).alias("_part"))
    return _named_objects(cut, ids, F.coalesce("_part.names", _chunk_names(F.col("_part.first"))))


def _window_chunks() -> Column:
    return chunks(F.col("replay_after_wal_id") + 1, F.col("next_wal_sst_id"))


def _chunk_names(first: Column) -> Column:
    return F.transform(chunk_ids(first, F.col("next_wal_sst_id")), wal_name)


def _named_objects(manifests: DataFrame, ids: list[str], names: Column) -> DataFrame:
    return manifests.select(*ids, F.explode(names).alias("object_name")).select(
        *ids, F.substring_index("object_name", "/", 1).alias("kind"), "object_name"
    )


def window_objects(manifests: DataFrame, keys: tuple[str, ...] = ("db_key",)) -> DataFrame:
    """Only the WAL-window objects of flat manifest rows, a chunk of a window at a time."""
    ids = [*keys, "manifest_id"]
    cut = manifests.select(*ids, "next_wal_sst_id", F.explode(_window_chunks()).alias("_first"))
    return _named_objects(cut, ids, _chunk_names(F.col("_first")))


def window_runs(manifests: DataFrame, keys: tuple[str, ...] = ("db_key",)) -> DataFrame:
    """(keys, manifest_id, start, end): the WAL window of each manifest that has one, as a run of ids."""
    return manifests.select(
        *keys, "manifest_id", (F.col("replay_after_wal_id") + 1).alias("start"), F.col("next_wal_sst_id").alias("end")
    ).filter("end > start")


def closure_runs(members: DataFrame, manifests: DataFrame, keys: tuple[str, ...] = ("db_key",)) -> DataFrame:
    """(keys, head, start, end): the WAL ids of each closure's windows as runs, however long they are."""
    windows = window_runs(manifests, keys).withColumnRenamed("manifest_id", "member_id")
    return merged(members.select(*keys, "head", "member_id").join(windows, [*keys, "member_id"]), [*keys, "head"])


def heads(manifests: DataFrame, keys: tuple[str, ...] = ("db_key",)) -> DataFrame:
    """The manifest row with the highest id per key.

    The highest ids come first, as numbers, which are hashed: the maximum of a whole
    row would sort all manifests that a task reads.
    """
    rest = [c for c in manifests.columns if c not in keys and c != "manifest_id"]
    highest = manifests.groupBy(*keys).agg(F.max("manifest_id").alias("manifest_id"))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (*keys, "manifest_id")]
    rows = manifests.alias("m").join(highest.alias("t"), same, "left_semi")
    # Of several rows with that id the largest is taken.
    top = rows.groupBy(*keys).agg(F.max(F.struct("manifest_id", *rest)).alias("h"))
    return top.select(*keys, "h.*")


def live_pins(checkpoints: DataFrame, carriers: DataFrame, now: Column,
              keys: tuple[str, ...] = ("db_key",)) -> DataFrame:
    """Live checkpoints carried by the given manifests: (keys, carrier, cp_id, pinned_id)."""
    wanted = carriers.select(*keys, "manifest_id")
    return (
        checkpoints.join(wanted, [*keys, "manifest_id"])
        .filter(checkpoint_live(F.col("expire_time"), now))
        .select(*keys, F.col("manifest_id").alias("carrier"), "cp_id", "pinned_id")
    )


def closure_members(catalog: Catalog, roots: DataFrame, now: Column,
                    keys: tuple[str, ...] = ("db_key",)) -> DataFrame:
    """(keys, head, member_id, present) of each root manifest's closure.

    A closure is the root and the manifests its live checkpoints pin, one
    level deep. ``present`` is false for a pinned manifest that is gone; what
    that means differs by job, so it is reported and not filtered here.
    """
    pinned = (
        live_pins(catalog.checkpoints, roots, now, keys)
        .filter(F.col("pinned_id") != F.col("carrier"))
        .select(*keys, F.col("carrier").alias("head"), F.col("pinned_id").alias("member_id"))
        .distinct()
    )
    known = catalog.manifests.select(
        *keys, F.col("manifest_id").alias("member_id"), F.lit(True).alias("present")
    )
    checked = pinned.join(known, [*keys, "member_id"], "left").withColumn(
        "present", F.coalesce("present", F.lit(False))
    )
    own = roots.select(
        *keys, F.col("manifest_id").alias("head"), F.col("manifest_id").alias("member_id"),
        F.lit(True).alias("present"),
    )
    return own.unionByName(checked.select(own.columns))


def member_objects(members: DataFrame, objects: DataFrame, keys: tuple[str, ...] = ("db_key",)) -> DataFrame:
    """(keys, head, member_id, kind, object_name) for closure members.

    The semi join comes first because, unlike the join, it can move below a
    distinct or union inside ``objects``: only members' rows get that far.
    """
    wanted = members.select(*keys, F.col("member_id").alias("manifest_id"))
    content = objects.join(wanted, [*keys, "manifest_id"], "left_semi")
    content = content.withColumnRenamed("manifest_id", "member_id")
    return members.select(*keys, "head", "member_id").join(content, [*keys, "member_id"])


def closure_objects(members: DataFrame, objects: DataFrame, keys: tuple[str, ...] = ("db_key",)) -> DataFrame:
    """The distinct objects of each closure."""
    return member_objects(members, objects, keys).select(*keys, "head", "kind", "object_name").distinct()


def object_counts(objects: DataFrame, by: list[str]) -> DataFrame:
    """WAL, compacted and total object counts per group."""
    return objects.groupBy(*by).agg(
        F.count_if(F.col("kind") == "wal").alias("n_wal"),
        F.count_if(F.col("kind") == "compacted").alias("n_compacted"),
        F.count(F.lit(1)).alias("n_objects"),
    )
