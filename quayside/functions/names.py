"""Object names as columns: registry entries, heartbeats, snapshot objects, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside.functions.urls import canonical_url, let

# The services in canonical order, and their letters in names.
SERVICES = ["gc", "compactor-coordinator", "compaction-workers", "mirror"]
SERVICE_LETTERS = {
    "gc": "g", "compactor-coordinator": "c", "compaction-workers": "w", "mirror": "m",
}

# Fixed value: registry file names may not be longer than this many bytes.
MAX_REGISTRY_NAME = 900

_SUFFIX = ".toml"
_MAX_U64 = "18446744073709551615"


def registry_name(url: Column) -> Column:
    """The registry file name of a canonical URL (all but unreserved encoded)."""
    encoded = F.url_encode(url)
    for java_form, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(java_form), F.lit(wanted))
    return F.concat(encoded, F.lit(_SUFFIX))


def registry_url(name: Column) -> Column:
    """The URL a registry file name encodes, NULL without the suffix or if the
    bytes are not UTF-8. A stray percent sign stands for itself."""
    stem = F.when(
        name.endswith(_SUFFIX), F.substring(name, F.lit(1), F.length(name) - len(_SUFFIX))
    )
    guarded = F.regexp_replace(stem, r"%(?![0-9A-Fa-f]{2})", "%25")
    guarded = F.replace(guarded, F.lit("+"), F.lit("%2B"))
    # The decoder turns bad bytes into U+FFFD: more of those than were spelled
    # out in the name means some bytes were bad.
    replacement = "\ufffd"
    spelled = F.regexp_count(stem, F.lit(f"(?i)%EF%BF%BD|{replacement}"))

    def if_whole(decoded: Column) -> Column:
        found = F.length(decoded) - F.length(F.replace(decoded, F.lit(replacement), F.lit("")))
        return F.when(found <= spelled, decoded)

    return let(F.try_url_decode(guarded), if_whole)


def registered_url(url: Column) -> Column:
    """``struct<url, file_name, reject_reason>`` for a database URL to register."""
    def checked(canonical: Column) -> Column:
        def judged(file_name: Column) -> Column:
            too_long = F.octet_length(file_name) > MAX_REGISTRY_NAME
            return F.struct(
                F.when(~too_long, canonical["url"]).alias("url"),
                F.when(~too_long, file_name).alias("file_name"),
                F.coalesce(
                    canonical["reject_reason"], F.when(too_long, F.lit("url too long for a registry name"))
                ).alias("reject_reason"),
            )

        return let(registry_name(canonical["url"]), judged)

    return let(canonical_url(url), checked)


def _count_letter(letters: Column, letter: str) -> Column:
    return F.length(letters) - F.length(F.replace(letters, F.lit(letter), F.lit("")))


def heartbeat_parts(name: Column) -> Column:
    """``struct<node_id, services>`` of a heartbeat object name, else NULL.

    The letters follow the last dot; unknown ones are ignored and the services
    come back in canonical order.
    """
    pattern = r"(?s)^(.+)\.([^.]*)\.json\z"
    letters = F.regexp_extract(name, pattern, 2)
    services = F.concat(
        *[
            F.array_repeat(F.lit(service), _count_letter(letters, SERVICE_LETTERS[service]))
            for service in SERVICES
        ]
    )
    return F.when(
        name.rlike(pattern),
        F.struct(F.regexp_extract(name, pattern, 1).alias("node_id"), services.alias("services")),
    )


def heartbeat_name(node_id: Column, services: Column) -> Column:
    """The heartbeat object name: letters sorted, each at most once."""
    letters = F.create_map(*[F.lit(x) for pair in SERVICE_LETTERS.items() for x in pair])
    sorted_letters = F.array_sort(F.array_distinct(F.transform(services, lambda s: letters[s])))
    return F.concat(node_id, F.lit("."), F.array_join(sorted_letters, ""), F.lit(".json"))


def object_class(path: Column) -> Column:
    """``struct<kind, id, ulid>`` of a snapshot object, NULL for other names.

    ``id`` is DECIMAL(20,0): object ids are unsigned 64-bit numbers. Padding is
    optional when reading.
    """
    none = F.lit(None)

    def numbered(kind: str, suffix: str) -> Column:
        def classed(digits: Column) -> Column:
            in_range = (F.length(digits) < 20) | ((F.length(digits) == 20) & (digits <= _MAX_U64))
            number = F.when((digits != "") & in_range, digits.try_cast("decimal(20,0)"))
            return let(number, lambda n: F.when(n.isNotNull(), F.struct(
                F.lit(kind).alias("kind"), n.alias("id"), none.cast("string").alias("ulid")
            )))

        return let(F.regexp_extract(path, rf"(?s)(?:^|/){kind}/\+?0*([0-9]+)\.{suffix}\z", 1), classed)

    compacted = let(F.regexp_extract(path, r"(?s)(?:^|/)compacted/([A-Za-z0-9]{26})\.sst\z", 1), lambda ulid: F.when(ulid != "", F.struct(
        F.lit("compacted").alias("kind"), none.cast("decimal(20,0)").alias("id"), ulid.alias("ulid")
    )))
    # A cheap look at the folder comes first, so that a name meets one pattern, and that once.
    folder = F.substring_index(path, "/", -2)
    return (
        F.when(folder.startswith("manifest/"), numbered("manifest", "manifest"))
        .when(folder.startswith("wal/"), numbered("wal", "sst"))
        .when(folder.startswith("compacted/"), compacted)
    )


def padded_id(number: Column) -> Column:
    return F.lpad(number.cast("string"), 20, "0")


def manifest_name(number: Column) -> Column:
    return F.concat(F.lit("manifest/"), padded_id(number), F.lit(".manifest"))


def wal_name(number: Column) -> Column:
    return F.concat(F.lit("wal/"), padded_id(number), F.lit(".sst"))


def compacted_name(ulid: Column) -> Column:
    return F.concat(F.lit("compacted/"), ulid, F.lit(".sst"))


def valid_identifier(name: Column) -> Column:
    """Node and target names: 1-128 of letters, digits, underscore, hyphen."""
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9_-]{1,128}\z"), F.lit(False))
