"""The registry of databases: one file per database, named for its URL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.names import registered_url, registry_url
from quayside.session import settle, spread


def registry_entries(listing: DataFrame) -> DataFrame:
    """Decode a listing of registry files: (file_name, size, decoded, url, reject_reason).

    Names are dealt to tasks by their number and decoded once, into a written
    table, since groups and warnings read it several times.
    """
    named = spread(listing).withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    decoded = named.withColumn("decoded", registry_url(F.col("file_name")))
    checked = decoded.withColumn("_r", registered_url(F.col("decoded")))
    entries = checked.select(
        "file_name",
        "size",
        "decoded",
        F.col("_r.url").alias("url"),
        F.when(F.col("decoded").isNull(), F.lit("not a registry file"))
        .otherwise(F.col("_r.reject_reason")).alias("reject_reason"),
    )
    return settle(entries, "registry-entries")


def alias_groups(entries: DataFrame) -> DataFrame:
    """Mark each valid entry with the file that stands for its database.

    The canonical spelling wins, then the smaller file name. The winner is an
    aggregate per url and joined back, so a url with very many spellings does
    not become one window. Winners are written first: a join that has plain
    shuffles on both sides can split such a url over several tasks.
    """
    valid = entries.filter(F.col("url").isNotNull()).withColumn(
        "is_alias", ~F.col("decoded").eqNullSafe(F.col("url"))
    )
    winners = valid.groupBy("url").agg(F.min(F.struct("is_alias", "file_name")).alias("w"))
    winners = settle(winners.select("url", F.col("w.file_name").alias("winner")), "registry-winners")
    return valid.join(winners, "url").withColumn("wins", F.col("file_name") == F.col("winner"))


def registry_warnings(entries: DataFrame, grouped: DataFrame) -> DataFrame:
    """(subject, message) rows for rejected, non-canonical and aliasing entries."""
    rejected = entries.filter(F.col("url").isNull()).select(
        F.col("file_name").alias("subject"),
        F.concat("file_name", F.lit(" is left out of the registry: "), "reject_reason").alias("message"),
    )
    odd = grouped.filter("is_alias").select(
        F.col("file_name").alias("subject"),
        F.concat("file_name", F.lit(" is not the preferred spelling of its url")).alias("message"),
    )
    aliases = grouped.filter(~F.col("wins")).select(
        F.col("file_name").alias("subject"),
        F.concat(
            "winner", F.lit(" stands for "), "url", F.lit(", which "), "file_name", F.lit(" names as well"),
        ).alias("message"),
    )
    return rejected.unionByName(odd).unionByName(aliases)
