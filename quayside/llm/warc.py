"""WARC archives of web captures: written, read back, and assembled to one nested row per capture.

A capture is a transaction of three records: the request, the response (or a
``revisit`` that only names an equal payload) and metadata. They are written
one after the other but need not be read that way, so they are put together by
their ``WARC-Concurrent-To`` identifiers.

Archives are written by Spark's own file writer, so only the output of a task
that succeeded is ever seen, and a lost executor's work is simply done again.
Every record is a gzip member of its own, as readers of WARC expect.

Defined results: a null payload is the empty one. A null page id is kept (its
metadata has no such field); it is never the one others refer to unless there is
nothing else, and then all of the group are responses. Rows that share payload
and smallest page id are all responses, so identical rows never point at
themselves. A null url is written without target. Payloads below ``least`` bytes
are always written out. An empty table makes no archive and no capture. Extra
columns are not read. When reading, a record that ends early ends its archive
with a row of type ``broken``.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import ready, whole_text
from quayside.session import settle

# Fixed value: payloads below so many bytes are not worth a reference.
LEAST_BYTES = 100
# A task closes an archive when it has about so many compressed bytes.
ARCHIVE_BYTES = 8 << 20
# Records are handed on when so many bytes of payload have gathered.
BATCH_BYTES = 4 << 20
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Spark's writer ends every row with a separator: a gzip member of nothing, which readers skip.
_NOTHING = gzip.compress(b"", mtime=0).decode("latin-1")

_RECORD = (
    "archive string, record_no bigint, type string, record_id string, concurrent_to array<string>, target_uri string, "
    "date string, content_type string, digest string, headers map<string,string>, fields map<string,string>, "
    "payload binary, payload_bytes bigint, payload_sha256 string"
)
_RECORD_ARROW = pa.schema([
    ("archive", pa.string()), ("record_no", pa.int64()), ("type", pa.string()), ("record_id", pa.string()),
    ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()), ("date", pa.string()),
    ("content_type", pa.string()), ("digest", pa.string()), ("headers", pa.map_(pa.string(), pa.string())),
    ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
    ("payload_sha256", pa.string()),
])


# ------------------------------------------------------------------- writing


def with_first_captures(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                        least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, first_id, first_url): what every page is written as.

    ``first_id`` is set where another page holds the payload. Only payloads
    found more than once are joined back; they are written first, so that a
    payload that many pages share is split by the join.
    """
    payload = whole_text(html)
    known = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    known = known.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    copies = known.filter(F.octet_length("payload") >= least).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    )
    firsts = settle(
        copies.filter((F.col("n") > 1) & F.col("first").isNotNull())
        .select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")),
        "first-captures",
    )
    other = F.coalesce(F.col("page_id") != F.col("first_id"), F.col("first_id").isNotNull())
    return known.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(other, F.col("first_id")).alias("first_id"), F.when(other, F.col("first_url")).alias("first_url"),
    )


def _value(text: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record, uncompressed; headers without a value are left out."""
    named = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in named if value is not None)
    return f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _identifier() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


def transaction(page_id, url: str | None, payload: bytes, digest: str, first_id, first_url: str | None, date: str) -> list[bytes]:
    """The request, response (or revisit) and metadata records of one page."""
    ids = [_identifier() for _ in range(3)]
    target = None if url is None else _value(url)
    try:
        parts = urlsplit(target or "")
        host, path = parts.netloc, parts.path + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        host, path = "", ""
    common = [("WARC-Date", date), ("WARC-Target-URI", target)]
    http = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first_id is None:
        main = record("response", [("WARC-Record-ID", ids[1]), *common, *http], answer + payload)
    else:
        refers = [
            ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To-Date", date),
            ("WARC-Refers-To-Target-URI", None if first_url is None else _value(first_url)),
        ]
        main = record("revisit", [("WARC-Record-ID", ids[1]), *common, *http, *refers], answer)
    joined = [("WARC-Concurrent-To", ids[1])]
    request = record(
        "request", [("WARC-Record-ID", ids[0]), *common, ("Content-Type", "application/http; msgtype=request"), *joined],
        f"GET {path or '/'} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(),
    )
    fields = "" if page_id is None else f"page-id: {quote(str(page_id), safe='')}\r\n"
    metadata = record(
        "metadata", [("WARC-Record-ID", ids[2]), *common, ("Content-Type", "application/warc-fields"), *joined], fields.encode()
    )
    return [request, main, metadata]


def write_archives(captures: DataFrame, path: str, date: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the rows of :func:`with_first_captures` as archives of bounded size under ``path``.

    Tasks write what they read, without a shuffle. A page never spans two archives.
    """
    ready(captures.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = record("warcinfo", [
            ("WARC-Date", date), ("WARC-Record-ID", _identifier()), ("Content-Type", "application/warc-fields"),
        ], b"format: WARC File Format 1.1\r\n")
        members, size = [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join([gzip.compress(info, 6), *members])], pa.binary())], ["archive"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                for one in transaction(*row, date):
                    members.append(gzip.compress(one, 6, mtime=0))
                    size += len(members[-1])
                if size >= archive_bytes:
                    yield archive()
                    members, size = [], 0
        if members:
            yield archive()

    rows = captures.select("page_id", "url", F.col("payload").cast("binary"), "digest", "first_id", "first_url")
    # Nothing checks that these strings are text: the bytes go to the file as they are.
    files = rows.mapInArrow(run, "archive binary").select(F.col("archive").cast("string"))
    files.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", _NOTHING).text(path)


# ------------------------------------------------------------------- reading


def _headers(lines: Iterator[bytes]) -> list[tuple[str, str]] | None:
    """The named fields up to an empty line; None if the stream ends before it. Folded lines are joined."""
    found: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            return found
        if text[0] in " \t" and found:
            found[-1] = (found[-1][0], f"{found[-1][1]} {text.strip()}".strip())
        else:
            name, _, value = text.partition(":")
            found.append((name.strip().lower(), value.strip()))
    return None


def _fields(block: bytes) -> list[tuple[str, str]]:
    return _headers(iter([*block.splitlines(), b""])) or []


def records_of(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes] | None]:
    """(headers, block) of every record of an archive, compressed or not; None where one is broken."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    try:
        while line := stream.readline():
            if not line.strip():
                continue
            headers = _headers(iter(stream.readline, b"")) if line.startswith(b"WARC/") else None
            length = dict(headers or []).get("content-length", "")
            block = stream.read(int(length)) if length.isdecimal() else None
            if block is None or len(block) < int(length):
                yield None
                return
            yield headers, block
    except (OSError, EOFError):
        yield None


def _row(archive: str, number: int, found) -> dict:
    if found is None:
        return {"archive": archive, "record_no": number, "type": "broken"}
    headers, block = found
    first = {}
    for name, value in headers:
        first.setdefault(name, value)
    content_type = first.get("content-type", "")
    payload = block
    if content_type.startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    fields = _fields(block) if content_type.startswith("application/warc-fields") else []
    return {
        "archive": archive, "record_no": number, "type": first.get("warc-type"), "record_id": first.get("warc-record-id"),
        "concurrent_to": [value for name, value in headers if name == "warc-concurrent-to"],
        "target_uri": first.get("warc-target-uri"), "date": first.get("warc-date"), "content_type": content_type,
        "digest": first.get("warc-payload-digest"), "headers": list(first.items()), "fields": list(dict(fields).items()),
        "payload": payload, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
    }


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``, in whatever order they come.

    Archives are dealt over the tasks; a task holds one at a time, and records
    are found by their lengths, never by searching for what payloads may
    contain. ``payload`` is the HTTP body, or the block of other records; its
    size and digest are taken from its bytes, not from a header.
    """
    ready(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for number, found in enumerate(records_of(content.as_py())):
                    rows.append(_row(archive, number, found))
                    size += len(rows[-1].get("payload", b""))
                    if size >= BATCH_BYTES or len(rows) >= 2_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_ARROW)

    return files.mapInArrow(run, _RECORD)


# ------------------------------------------------------------------ assembly

_LIGHT = [name for name in _RECORD_ARROW.names if name != "payload"]


def _one_of(kind: str) -> Column:
    """The first record of a kind, and nothing else however many there are."""
    place = F.struct("archive", "record_no")
    body = F.struct("record_id", "date", "content_type", "headers", "fields", "payload_bytes", "payload_sha256")
    return F.min_by(F.when(F.col("type") == kind, body), F.when(F.col("type") == kind, place))


def assemble(records: DataFrame, payloads: bool = False) -> DataFrame:
    """One nested row per capture: ``response`` (a revisit too), ``request``, ``metadata``.

    A capture is a response or revisit record. Other records belong to the one
    that they name in ``WARC-Concurrent-To``, that names them (some writers
    put the field there), or that the request belongs to which they name. Of
    several requests or metadata records of a capture the first by archive and
    place is taken, by aggregates that combine before the shuffle, so a capture
    that very many records name stays one small row. Missing ones are null, and
    records that lead to no capture are left out. With ``payloads`` the bytes
    are fetched from the archives again, at the end.
    """
    light = settle(records.select(*_LIGHT), "warc-records")
    main = light.filter(F.col("type").isin("response", "revisit"))
    pointers = main.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture"))
    rest = light.filter(F.col("type").isin("request", "metadata")).withColumn("to", F.get("concurrent_to", F.lit(0)))

    def belongs(companions: DataFrame, named: DataFrame) -> DataFrame:
        named = named.groupBy("record_id").agg(F.min("capture").alias("capture"))
        by_name = named.select("record_id", F.col("capture").alias("_own"))
        by_other = named.select(F.col("record_id").alias("to"), F.col("capture").alias("_other"))
        return companions.join(by_name, "record_id", "left").join(by_other, "to", "left").withColumn(
            "capture", F.coalesce("_own", "_other", "to")
        )

    requests = belongs(rest.filter("type = 'request'"), pointers)
    through = pointers.unionByName(requests.select("record_id", "capture").filter("capture IS NOT NULL"))
    others = belongs(rest.filter("type = 'metadata'"), through)
    companions = requests.unionByName(others).filter("capture IS NOT NULL").groupBy("capture").agg(
        _one_of("request").alias("request"), _one_of("metadata").alias("metadata")
    )
    body = [name for name in _LIGHT if name not in ("archive", "record_no")]
    if payloads:
        main = main.join(records.select("archive", "record_no", "payload"), ["archive", "record_no"])
        body.append("payload")
    captures = main.select(F.col("record_id").alias("capture"), F.struct(*body).alias("response"))
    return captures.join(companions, "capture", "left").select("capture", "response", "request", "metadata")


def resolved(captures: DataFrame, page_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits looked up by digest.

    Of several responses with a payload the one of the smallest page id is
    referred to. A revisit whose response is in no archive has null for its
    size and reference.
    """
    flat = captures.select(
        F.url_decode(F.try_element_at("metadata.fields", F.lit("page-id"))).cast(page_type).alias("page_id"),
        F.col("response.type").alias("record_type"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.when(F.col("response.type") == "response", F.col("response.payload_sha256"))
        .otherwise(F.regexp_extract("response.digest", "^sha256:([0-9a-f]+)$", 1)).alias("payload_digest"),
    )
    held = flat.filter("record_type = 'response'").groupBy("payload_digest").agg(
        F.min("page_id").alias("_held_id"), F.min("payload_bytes").alias("_held_bytes")
    )
    revisit = F.col("record_type") == "revisit"
    return flat.join(held, "payload_digest", "left").select(
        "page_id", F.when(revisit, F.col("_held_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest", "record_type", F.when(revisit, F.col("_held_id")).alias("refers_to"),
    )
