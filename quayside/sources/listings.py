"""Object listings: (path, last_modified, size, etag) rows, and what names say."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.names import heartbeat_parts, object_class
from quayside.functions.predicates import age_micros
from quayside.session import settle


_LISTED = "root string, path string, last_modified timestamp, size bigint, etag string, folder boolean"


def list_objects(roots: DataFrame) -> DataFrame:
    """LIST the folders of ``roots`` (column ``root``): one row per object.

    Folders are listed level by level: those of a level are dealt over as many
    tasks as the session shuffles to, and what they hold is written before the
    next level, so one root is listed by many tasks and a task holds one folder at a
    time. This runs when it is called, not when its result is read. A missing
    folder is an empty listing; any other error fails the job. (Spark's own
    file sources leave out empty files, and an empty registry file is a
    registered database.) Use an inventory table for folders too large to list.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for root, path in zip(batch["root"], batch["path"]):
                store, top = fs.FileSystem.from_uri(root)
                infos = store.get_file_info(fs.FileSelector(path or top, allow_not_found=True))
                if not infos:
                    continue
                yield pd.DataFrame({
                    "root": root, "path": [info.path for info in infos],
                    "last_modified": pd.to_datetime(pd.Series([info.mtime for info in infos], dtype="object"), utc=True),
                    "size": pd.array([info.size for info in infos], dtype="Int64"), "etag": None,
                    "folder": [info.type == fs.FileType.Directory for info in infos],
                })

    tasks = int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level, found = roots.select("root", F.lit(None).cast("string").alias("path")).distinct(), None
    while True:
        listed = settle(level.repartition(tasks, "root", "path").mapInPandas(run, _LISTED), "listed")
        objects = listed.filter("NOT folder").drop("folder")
        found = objects if found is None else found.unionByName(objects)
        level = listed.filter("folder").select("root", "path")
        if level.isEmpty():
            return found


def heartbeat_entries(listing: DataFrame, now: Column) -> DataFrame:
    """(node_id, services, age_micros, location, last_modified) of heartbeat objects.

    Objects with other names are ignored. Only names and times are used.
    """
    name = F.element_at(F.split("path", "/"), -1)
    return (
        listing.withColumn("_hb", heartbeat_parts(name))
        .filter(F.col("_hb").isNotNull())
        .select(
            F.col("_hb.node_id").alias("node_id"),
            F.col("_hb.services").alias("services"),
            age_micros(now, F.col("last_modified")).alias("age_micros"),
            F.col("path").alias("location"),
            "last_modified",
        )
    )


def snapshot_listings(listing: DataFrame, keys: tuple[str, ...] = ("db_key",)) -> DataFrame:
    """Snapshot objects of all kinds in one pass: manifest and wal by ``id``, compacted by ``ulid``.

    Names that do not parse are skipped. Rows come unsorted: sort at the end,
    once, if a reader needs the order.
    """
    # Exploded, so that each name is taken apart once and not again for the filter.
    classed = listing.withColumn("_c", F.explode(F.array_compact(F.array(object_class(F.col("path"))))))
    rest = [c for c in ("last_modified", "size", "etag") if c in listing.columns]
    return classed.select(*keys, "_c.kind", "_c.id", "_c.ulid", "path", *rest)


def snapshot_listing(listing: DataFrame, kind: str, keys: tuple[str, ...] = ("db_key",)) -> DataFrame:
    """The rows of :func:`snapshot_listings` of one kind, with the number that it has."""
    ours = snapshot_listings(listing.filter(F.contains("path", F.lit(f"{kind}/"))), keys).filter(F.col("kind") == kind)
    return ours.drop("kind", "id" if kind == "compacted" else "ulid")
