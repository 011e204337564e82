"""Writers that create an object only where there is none, run on the executors.

An object appears whole or not at all, and of any number of writers one
creates it; the others learn whether what is there equals their own. Where
objects are files this is a hard link to a finished scratch file, which fails
if the name is taken. Other stores are refused: the file system layer used
here cannot ask them for a conditional put.

A task that is run again finds what it wrote before and calls it ``same``, so
``created`` may be fewer than the objects that are new, never more.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

CREATED, SAME, DIVERGED, STOPPED = "created", "same", "diverged", "stopped"


def _file_of(uri: str) -> str:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if store.type_name != "local":
        raise ValueError(f"no conditional writes to {store.type_name} stores")
    return path


def create_file(path: str, content: bytes) -> str:
    """Create one file, unless its name is taken: ``created``, ``same`` or ``diverged``."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    scratch = os.path.join(os.path.dirname(path), f"{uuid.uuid4().hex}.tmp")
    try:
        with open(scratch, "xb") as out:
            out.write(content)
        os.link(scratch, path)
        return CREATED
    except FileExistsError:
        with open(path, "rb") as held:
            return SAME if held.read() == content else DIVERGED
    finally:
        if os.path.exists(scratch):
            os.unlink(scratch)


def create_objects(contents: DataFrame, root: str) -> DataFrame:
    """Create (object_name, content) rows under a root: (object_name, outcome).

    Rows that share a name are writers that compete: one of them creates it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Names are joined to the folder and not to its URI, in which percent signs would have a meaning.
        folder = _file_of(root)
        for batch in batches:
            outcomes = [create_file(f"{folder}/{name}", bytes(content)) for name, content in zip(batch["object_name"], batch["content"])]
            yield pd.DataFrame({"object_name": batch["object_name"], "outcome": outcomes})

    return contents.select("object_name", "content").mapInPandas(run, "object_name string, outcome string")


def commit_objects(members: DataFrame, keys: list[str], seq: str, tasks: int | None = None) -> DataFrame:
    """Commit each pair's members in ascending ``seq``, the last being its head: (keys, seq, outcome).

    ``members`` has the ``keys``, ``seq``, ``dest`` (a URI) and ``content``. A
    member whose name holds something else stops its pair: what follows, the
    head above all, is not written (``stopped``). So a pair that is cut off at
    any point holds the first of its members, and a second run goes on there.

    A pair is written in order by one task, which reads it as a stream; pairs
    are dealt over ``tasks``, by default as many as the session shuffles to.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, broken = None, False
        for batch in batches:
            outcomes = []
            for pair, dest, content in zip(zip(*[batch[k] for k in keys]), batch["dest"], batch["content"]):
                if pair != current:
                    current, broken = pair, False
                outcome = STOPPED if broken else create_file(_file_of(dest), bytes(content))
                broken = broken or outcome == DIVERGED
                outcomes.append(outcome)
            yield batch[[*keys, seq]].assign(outcome=outcomes)

    tasks = tasks or int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    types = "".join(f"{field.name} {field.dataType.simpleString()}, " for field in members.select(*keys, seq).schema)
    ordered = members.select(*keys, seq, "dest", "content").repartition(tasks, *keys).sortWithinPartitions(*keys, seq)
    return ordered.mapInPandas(run, types + "outcome string")
