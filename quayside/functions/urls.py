"""URL columns: canonical spelling, path prefixes and copy-tool remotes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The URL schemes that name an object store.
SCHEMES = [
    "s3", "s3a", "gs", "az", "adl", "azure", "abfs", "abfss", "file", "memory", "http", "https",
]

# The copy-tool backend of each scheme family.
REMOTE_BACKENDS = {
    ":s3,env_auth": ["s3", "s3a"],
    ":gcs,env_auth": ["gs"],
    ":azureblob,env_auth": ["az", "azure", "abfs", "abfss", "adl"],
}

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
# User information reaches to the last @; the host follows it.
_USER = r"^(.*@)?"
_REST = r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?(.*)\z"
# Characters a URL parser percent-encodes in a path; everything outside
# printable ASCII is included.
_NEEDS_ENCODING = r"""[^\x21-\x7e]|["<>`{}]"""


def _percent_encode_unsafe(text: Column) -> Column:
    def encode(c: Column) -> Column:
        return F.when(
            c.rlike(_NEEDS_ENCODING), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
        ).otherwise(c)

    return F.when(
        text.rlike(_NEEDS_ENCODING), F.array_join(F.transform(F.split(text, ""), encode), "")
    ).otherwise(text)


def _fold_dot_segments(path: Column) -> Column:
    """Drop ``.`` segments and let ``..`` remove the segment before it."""

    def step(kept: Column, part: Column) -> Column:
        plain = F.replace(F.lower(part), F.lit("%2e"), F.lit("."))
        return (
            F.when(plain == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))))
            .when(plain == ".", kept)
            .otherwise(F.concat(kept, F.array(part)))
        )

    folded = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"), step
    )
    return F.when(path.rlike(r"(?i)/(\.|%2e)"), F.array_join(folded, "/")).otherwise(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used.

    Column expressions are trees: using a sub-expression five times copies it
    five times. A one-element array binds it to a name instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def canonical_url(url: Column) -> Column:
    """``struct<url, reject_reason>``: one spelling per location.

    Scheme and host are lower-cased, user information and path keep their case, unsafe characters are
    percent-encoded, dot segments are folded, a web scheme's default port is
    dropped, and every trailing slash is removed. A URL that does not parse or
    whose scheme is not in :data:`SCHEMES` has a NULL ``url`` and a reason.
    """
    text = F.regexp_replace(F.trim(url), r"[\t\r\n]", "")

    def take_apart(t: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(t, _SCHEME, 1)).alias("scheme"),
            F.regexp_extract(F.regexp_extract(t, _AUTHORITY, 1), _USER, 1).alias("user"),
            F.lower(F.regexp_replace(F.regexp_extract(t, _AUTHORITY, 1), _USER, "")).alias("host"),
            t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://").alias("has_authority"),
            _percent_encode_unsafe(F.regexp_extract(t, _REST, 1)).alias("rest"),
        )

    def path_of(p: Column) -> Column:
        path = F.regexp_extract(p["rest"], r"(?s)^([^?#]*)", 1)
        return F.when(p["has_authority"], let(path, _fold_dot_segments)).otherwise(path)

    def put_together(p: Column) -> Column:
        web = p["scheme"].isin("http", "https")
        port = F.when(p["scheme"] == "http", F.lit(":80")).otherwise(F.lit(":443"))
        host = F.when(
            web & p["host"].endswith(port), F.left(p["host"], F.length(p["host"]) - F.length(port))
        ).otherwise(p["host"])
        # A web URL always has a path; without one the query follows a slash.
        path = let(path_of(p), lambda x: F.when(web & (x == ""), F.lit("/")).otherwise(x))
        tail = F.regexp_extract(p["rest"], r"(?s)^[^?#]*(.*)\z", 1)
        joined = F.concat(
            p["scheme"], F.when(p["has_authority"], F.lit("://")).otherwise(F.lit(":")), p["user"], host, path, tail
        )
        reason = (
            F.when(p["scheme"].isNull() | (p["scheme"] == ""), F.lit("invalid URL"))
            .when(~p["scheme"].isin(*SCHEMES), F.concat(F.lit("unsupported URL scheme "), p["scheme"]))
            .when(web & (p["host"] == ""), F.lit("invalid URL"))
            .when(p["host"].rlike(r"[\x00-\x20<>\\^|%]"), F.lit("invalid URL"))
        )
        return let(
            reason,
            lambda r: F.struct(
                F.when(r.isNull(), F.rtrim(joined, F.lit("/"))).alias("url"), r.alias("reject_reason")
            ),
        )

    return let(text, lambda t: let(take_apart(t), put_together))


def path_prefixes(url: Column) -> Column:
    """Every prefix of ``url`` that ends at a path-segment boundary, plus ``''``.

    The empty prefix stands for "no prefix asked for", which lets targets
    without one be matched by the same equi-join.
    """
    parts = F.split(url, "/")
    cuts = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    return F.concat(F.array(F.lit("")), cuts)


def copy_remote(url: Column) -> Column:
    """``struct<remote, error>``: the copy tool's name for an object-store URL."""
    scheme = F.lower(F.regexp_extract(url, _SCHEME, 1))
    host = F.regexp_extract(url, _AUTHORITY, 1)
    path = F.regexp_extract(F.regexp_extract(url, _REST, 1), r"(?s)^([^?#]*)", 1)
    remote = F.when(scheme == "file", F.try_url_decode(path))
    for backend, schemes in REMOTE_BACKENDS.items():
        remote = remote.when(
            scheme.isin(*schemes),
            F.concat(F.lit(backend + ":"), host, F.lit("/"), F.ltrim(path, F.lit("/"))),
        )
    error = (
        F.when(url.isNull() | (scheme == ""), F.lit("cannot map URL to a remote"))
        .when(remote.isNull(), F.concat(F.lit("no backend for scheme "), scheme))
    )
    return F.struct(remote.alias("remote"), error.alias("error"))
