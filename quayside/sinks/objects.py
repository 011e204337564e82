"""Moving and deleting objects on the executors.

Rows are (source or path, ...) URIs; bytes never leave the task that moves
them. Copying an immutable object again and deleting one that is already gone
are both fine, so a lost executor's task can simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes read per step of a streamed copy.
CHUNK_BYTES = 8 * 1024 * 1024

_COPIED = "name string, bytes bigint, error string"
_DELETED = "path string, deleted boolean, error string"


# Objects of one target that are copied at a time, unless the plan says otherwise.
COPIED_AT_ONCE = 8


def _open(uri: str):
    from pyarrow import fs

    # What Hadoop calls s3a or s3n is the same store.
    scheme, colon, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") and colon else uri)


def _copy_one(source: str, dest: str) -> int:
    from_fs, from_path = _open(source)
    to_fs, to_path = _open(dest)
    if to_fs.type_name == "local":
        to_fs.create_dir(to_path.rsplit("/", 1)[0], recursive=True)
    moved = 0
    with from_fs.open_input_stream(from_path) as reader, to_fs.open_output_stream(to_path) as writer:
        while chunk := reader.read(CHUNK_BYTES):
            writer.write(chunk)
            moved += len(chunk)
    return moved


def copy_rows(plan: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """Copy every row's ``source`` URI to its ``dest`` URI: the ``keys``, name, bytes, error.

    A plan may mix any number of databases and targets; the rows are dealt
    evenly over ``tasks``, by default as many as the session shuffles to. With a
    column ``copy_parallelism`` the rows of each of the ``keys`` are dealt over
    at most so many of them, so that no target is asked for more at a time. A
    failed object carries its error instead of failing the others.
    """
    slots = None
    if "copy_parallelism" in plan.columns:
        at_once = F.greatest(F.coalesce("copy_parallelism", F.lit(COPIED_AT_ONCE)), F.lit(1))
        slots = F.pmod(F.xxhash64("object_name"), at_once)
    kept = plan.select(*keys, "object_name", "source", "dest", (F.lit(0) if slots is None else slots).alias("_slot"))
    columns = [*keys, "name", "bytes", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            moved, errors = [], []
            for source, dest in zip(batch["source"], batch["dest"]):
                try:
                    moved.append(_copy_one(source, dest))
                    errors.append(None)
                except OSError as error:
                    moved.append(None)
                    errors.append(type(error).__name__)
            out = batch[keys].assign(name=batch["object_name"], bytes=pd.array(moved, dtype="Int64"), error=errors)
            yield out[columns]

    tasks = tasks or int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    types = "".join(f"{field.name} {field.dataType.simpleString()}, " for field in kept.select(*keys).schema)
    dealt = kept.repartition(tasks) if slots is None else kept.repartition(tasks, *keys, "_slot")
    return dealt.mapInPandas(run, types + _COPIED)


def copy_objects(plan: DataFrame, source_root: str, dest_root: str, tasks: int | None = None) -> DataFrame:
    """Copy the named objects from one root to another: (name, bytes, error).

    ``plan`` has ``object_name``, relative to both roots.
    """
    rooted = plan.select(
        "object_name", F.concat(F.lit(f"{source_root}/"), "object_name").alias("source"),
        F.concat(F.lit(f"{dest_root}/"), "object_name").alias("dest"),
    )
    return copy_rows(rooted, [], tasks)


def copied_totals(copied: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Objects and bytes moved and objects that failed, in one row, or one per value of the ``keys``."""
    return copied.groupBy(*(keys or [])).agg(
        F.count_if(F.col("error").isNull()).alias("objects"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def put_objects(contents: DataFrame, root: str) -> DataFrame:
    """Write (object_name, content) rows as objects under a root: (name, bytes, error)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["object_name"], batch["content"]):
                try:
                    to_fs, to_path = _open(f"{root}/{name}")
                    if to_fs.type_name == "local":
                        to_fs.create_dir(to_path.rsplit("/", 1)[0], recursive=True)
                    with to_fs.open_output_stream(to_path) as writer:
                        writer.write(bytes(content))
                    rows.append((name, len(content), None))
                except OSError as error:
                    rows.append((name, None, type(error).__name__))
            yield pd.DataFrame(rows, columns=["name", "bytes", "error"]).astype({"bytes": "Int64"})

    return contents.select("object_name", "content").mapInPandas(run, _COPIED)


def delete_objects(paths: DataFrame, dry_run: bool = True) -> DataFrame:
    """Delete the objects of ``paths`` (column ``path``): (path, deleted, error).

    An object that is already missing counts as deleted. Nothing is touched
    unless ``dry_run`` is switched off. Run the manifests' phase to its end
    before the data objects'.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    fs, inner = _open(path)
                    fs.delete_file(inner)
                    rows.append((path, True, None))
                except FileNotFoundError:
                    rows.append((path, True, None))
                except OSError as error:
                    rows.append((path, False, type(error).__name__))
            yield pd.DataFrame(rows, columns=["path", "deleted", "error"])

    if dry_run:
        return paths.select("path", F.lit(False).alias("deleted"), F.lit(None).cast("string").alias("error"))
    return paths.select("path").mapInPandas(run, _DELETED)


def export_copy_list(copies: DataFrame, path: str) -> None:
    """Write the relative names of data objects, one per line; never manifests."""
    (
        copies.filter(F.col("kind") != "manifest").select("object_name").distinct()
        .write.mode("overwrite").text(path)
    )
