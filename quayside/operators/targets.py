"""Which mirror targets apply to which databases, and where they lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.urls import canonical_url, path_prefixes
from quayside.session import settle

def _usable(targets: DataFrame) -> DataFrame:
    """Enabled targets whose url (and prefix, if any) canonicalize."""
    return (
        targets.filter(~F.col("disabled") & F.col("url").isNotNull())
        .withColumn("_to", canonical_url(F.col("url"))["url"])
        .withColumn(
            "_from",
            F.when(F.col("source_prefix").isNull(), F.lit("")).otherwise(
                canonical_url(F.col("source_prefix"))["url"]
            ),
        )
        .filter(F.col("_to").isNotNull() & F.col("_from").isNotNull())
    )


def _destination(db_url: Column) -> Column:
    """Prefix targets keep the rest of the path; others are exact destinations."""
    rest = F.when(F.col("_from") == "", F.lit("")).otherwise(
        F.substring(db_url, F.length("_from") + 1, F.length(db_url))
    )
    return F.concat(F.col("_to"), rest)


def applied_targets(databases: DataFrame, inherited: DataFrame, tuned: DataFrame | None = None) -> DataFrame:
    """The enabled targets that apply to each database, with ``destination``.

    ``databases`` is (db_key, db_url); ``inherited`` and ``tuned`` come from
    :func:`quayside.operators.settings.merge_targets`. A prefix matches at
    path-segment boundaries: each url is taken apart into its prefixes, so the
    match is an equi-join. A destination equal to the source never applies.
    The targets are written first: of known size, they are broadcast while they
    are few, and the databases, which look small on disk, are not.
    """
    settings = [c for c in inherited.columns if c not in ("target", "url", "source_prefix", "disabled")]
    out = ["db_key", "db_url", "target", "destination", *settings]
    exploded = databases.select("db_key", "db_url", F.explode(path_prefixes(F.col("db_url"))).alias("_from"))
    matched = exploded.join(settle(_usable(inherited), "usable-targets"), "_from")
    if tuned is not None:
        # A database's own row replaces the fleet target of that name.
        matched = matched.join(tuned.select("db_key", "target"), ["db_key", "target"], "left_anti")
    matched = matched.withColumn("destination", _destination(F.col("db_url"))).select(*out)
    if tuned is not None:
        own = databases.select("db_key", "db_url").join(_usable(tuned), "db_key")
        own = own.filter(F.array_contains(path_prefixes(F.col("db_url")), F.col("_from")))
        matched = matched.unionByName(
            own.withColumn("destination", _destination(F.col("db_url"))).select(*out)
        )
    return matched.filter(F.col("destination") != F.col("db_url"))


def collisions(applied: DataFrame) -> DataFrame:
    """Every source of a destination that more than one (database, target) maps to.

    One row per source, with the size of its group: a destination may have any
    number of sources, so they are not gathered into one value. The sizes are
    written first, so that the join can split a very popular destination.
    """
    sizes = settle(
        applied.groupBy("destination").agg(F.count(F.lit(1)).alias("n_sources"))
        .filter(F.col("n_sources") > 1),
        "collision-sizes",
    )
    return applied.join(sizes, "destination").select(
        "destination",
        F.concat("db_url", F.lit(" by target "), "target").alias("source"),
        "n_sources",
    )


def collision_messages(collided: DataFrame) -> DataFrame:
    """One message per source of a shared destination, whatever the number of sources."""
    return collided.select(
        F.col("destination").alias("subject"),
        F.concat(
            "source", F.lit(" shares the destination "), "destination", F.lit(", one of "), F.col("n_sources").cast("string")
        ).alias("message"),
    )


def registered_destinations(applied: DataFrame, databases: DataFrame) -> DataFrame:
    """Destinations that are themselves registered databases."""
    registered = databases.select(F.col("db_url").alias("destination"))
    # As many as databases: not to be broadcast.
    return applied.select("destination").distinct().join(registered.hint("merge"), "destination", "left_semi")


def unmirrored(mirroring: DataFrame, applied: DataFrame) -> DataFrame:
    """Databases that want mirroring and have no applicable target."""
    return mirroring.join(applied.select("db_key").hint("merge"), "db_key", "left_anti")
