import gzip
import hashlib

from quayside.llm import warc
from quayside.session import shared_dir

DATE = "2024-01-01T00:00:00Z"


def expected(rows):
    """The contract, page by page."""
    payloads = [(page_id, (html or "").encode()) for page_id, html in rows]
    smallest = {}
    for page_id, data in payloads:
        if page_id is not None:
            smallest[data] = min(smallest.get(data, page_id), page_id)
    out = []
    for page_id, data in payloads:
        first = smallest.get(data) if len(data) >= 100 else None
        refers = first if first is not None and first != page_id else None
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def captured(spark, rows, schema, **options):
    path = shared_dir(spark, "warc-test")
    warc.write_archives(warc.with_first_captures(spark.createDataFrame(rows, schema)), path, DATE, **options)
    return path, warc.assemble(warc.read_records(spark, path))


def test_hard_pages_come_back(spark):
    trap = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 3
    rows = [
        (7, "http://a/x y", trap), (3, "http://b/\r\nWARC-Type: request", trap), (3, "http://b/", trap), (9, None, trap),
        (None, "http://c/[", trap), (1, "http://d/", None), (2, "http://d/", ""), (4, "http://e/", "x" * 99), (5, "", "x" * 99),
        (6, "http://f/", "é" * 50), (8, "http://\u4e2d/", "é" * 50), (None, "u", "n" * 200), (None, "u", "n" * 200), (10, "v", "long " * 200_000),
    ]
    schema = "page_id bigint, url string, html string"
    for options in ({}, {"archive_bytes": 1}):
        path, captures = captured(spark, rows, schema, **options)
        got = [tuple(r) for r in warc.resolved(captures).collect()]
        assert sorted(got, key=repr) == expected([(page_id, html) for page_id, _, html in rows])
    nested = {r.metadata.fields.get("page-id"): r for r in captures.collect()}
    assert nested["7"].request.headers["warc-type"] == "request" and nested["7"].response.target_uri == "http://a/x%20y"
    assert "WARC-Type: request" not in str(nested["3"].request.headers)
    bodies = warc.assemble(warc.read_records(spark, path), payloads=True).collect()
    assert {bytes(r.response.payload) for r in bodies if r.response.type == "response"} >= {trap.encode(), b"", b"long " * 200_000}


def test_clashing_columns_and_text_ids(spark):
    rows = [("b c", "u", "p" * 100, 1, "x", "y"), ("a%2", "u", "p" * 100, 2, "x", "y")]
    _, captures = captured(spark, rows, "page_id string, url string, html string, payload int, digest string, first_id string")
    got = {tuple(r)[0]: (r.record_type, r.refers_to) for r in warc.resolved(captures, "string").collect()}
    assert got == {"a%2": ("response", None), "b c": ("revisit", "a%2")}


def test_no_pages(spark):
    _, captures = captured(spark, [], "page_id bigint, url string, html string")
    assert warc.resolved(captures).collect() == []


def written(spark, archives):
    path = shared_dir(spark, "warc-test")
    rows = spark.createDataFrame([(bytearray(a),) for a in archives], "a binary").selectExpr("cast(a AS string) AS a")
    rows.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", warc._NOTHING).text(path)
    return warc.read_records(spark, path)


def plain(kind, record_id, to=(), block=b"", content_type="application/http"):
    headers = [("WARC-Record-ID", record_id), ("Content-Type", content_type), *(("WARC-Concurrent-To", t) for t in to)]
    return warc.record(kind, headers, block)


def test_links_in_any_direction_and_order(spark):
    page_id = b"page-id: %d\r\n"
    fields = "application/warc-fields"
    archives = [
        # Metadata first; the response names its request, and the metadata only the request.
        gzip.compress(plain("metadata", "m1", ["q1"], page_id % 1, fields)) + gzip.compress(plain("response", "r1", ["q1"], b"h\r\n\r\nbody")),
        # The request is in another archive than the response, whose fields are folded over two lines.
        gzip.compress(plain("request", "q1") + plain("request", "q2", ["r2"]) + plain("request", "q3", ["r2"])),
        gzip.compress(b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID:\r\n r2\r\nContent-Length: 0\r\n\r\n\r\n\r\n"),
        # Nobody's records, and a response of nobody.
        gzip.compress(plain("metadata", "m9", ["nothing"], page_id % 9, fields) + plain("request", "q9") + plain("response", "r9")),
    ]
    got = {r.capture: r for r in warc.assemble(written(spark, archives)).collect()}
    assert set(got) == {"r1", "r2", "r9"}
    assert (got["r1"].request.record_id, got["r1"].metadata.fields, got["r1"].response.payload_bytes) == ("q1", {"page-id": "1"}, 4)
    assert (got["r2"].request.record_id, got["r2"].metadata) == ("q2", None)
    assert (got["r9"].request, got["r9"].metadata) == (None, None)


def test_records_of_broken_and_plain_archives():
    whole = plain("response", "r", [], b"h\r\n\r\nbody")
    assert [block for _, block in warc.records_of(whole * 2)] == [b"h\r\n\r\nbody"] * 2
    cut = list(warc.records_of(whole + whole[:-8]))
    assert len(cut) == 2 and cut[1] is None
    assert list(warc.records_of(gzip.compress(whole)[:-9]))[-1] is None
    assert list(warc.records_of(b"no archive")) == [None]
    assert list(warc.records_of(b"")) == []
