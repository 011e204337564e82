"""Registering databases in bulk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.names import registered_url
from quayside.session import settle
from quayside.sinks.commit import create_if_absent
from quayside.sinks.conditional import CREATED, create_objects
from quayside.sources.listings import list_objects


def register_batch(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """(request_id, url, file_name, created, reject_reason) per requested URL.

    ``requests`` is (request_id, url) and ``registry`` the file names that
    exist. Of several requests for one database the smallest id creates it. An
    existing file is never overwritten.
    """
    checked = requests.withColumn("_r", registered_url(F.col("url"))).select(
        "request_id", "_r.url", "_r.file_name", "_r.reject_reason"
    )
    good = checked.filter(F.col("reject_reason").isNull())
    return create_if_absent(good, registry.select("file_name"), "file_name", "request_id").unionByName(
        checked.filter(F.col("reject_reason").isNotNull()).withColumn("created", F.lit(False))
    )


def register_written(requests: DataFrame, root: str) -> DataFrame:
    """:func:`register_batch` against the files under ``root``, and an empty file written for each new database.

    A file that another writer created in the meantime is left alone, and its
    request has not created it.
    """
    roots = requests.sparkSession.createDataFrame([(root,)], "root string")
    held = list_objects(roots).select(F.element_at(F.split("path", "/"), -1).alias("file_name"))
    planned = settle(register_batch(requests, held), "registrations")
    files = planned.filter("created").select(
        F.col("file_name").alias("object_name"), F.encode(F.lit(""), "UTF-8").alias("content")
    )
    won = settle(create_objects(files, root), "registered").filter(F.col("outcome") == CREATED)
    won = won.select(F.col("object_name").alias("file_name"), F.lit(True).alias("_won"))
    return (
        planned.join(won, "file_name", "left")
        .withColumn("created", F.col("created") & F.coalesce("_won", F.lit(False)))
        .select(*planned.columns)
    )
