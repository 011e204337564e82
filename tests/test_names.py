from pyspark.sql import functions as F

from quayside.functions import durations, names, urls


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def canonical(spark, values):
    return [r["url"] for r in column(spark, values, urls.canonical_url)]


def test_canonical_urls_fold_case_and_slashes(spark):
    given = ["S3://Bucket/Path/db/", "s3://b/db", "s3://b/db//", "https://Host.example:443/a/../b/./c", "http://h",
             "file:///var/data/", "memory:///db", "gs://b/a b/ü", " s3://b/x\n"]
    want = ["s3://bucket/Path/db", "s3://b/db", "s3://b/db", "https://host.example/b/c", "http://h",
            "file:///var/data", "memory:///db", "gs://b/a%20b/%C3%BC", "s3://b/x"]
    assert canonical(spark, given) == want
    assert canonical(spark, want) == want


def test_bad_urls_have_reasons(spark):
    out = column(spark, ["not a url", "ftp://h/db", "https:///x", "s3://a b/x", None], urls.canonical_url)
    assert [r["url"] for r in out] == [None] * 5
    assert [r["reject_reason"] for r in out] == [
        "invalid URL", "unsupported URL scheme ftp", "invalid URL", "invalid URL", "invalid URL",
    ]


def test_authority_keeps_its_user_and_host(spark):
    given = ["https://user:pw@Host:443/x", "http://[::1]:80/a", "https://User@Host/A", "http://[::1]:8080/a", "https://a:b@c@D:443", "https://h:4430/x", "s3://U@B/k"]
    assert canonical(spark, given) == [
        "https://user:pw@host/x", "http://[::1]/a", "https://User@host/A", "http://[::1]:8080/a", "https://a:b@c@d", "https://h:4430/x", "s3://U@b/k"]


def test_registry_names_round_trip(spark):
    given = ["s3://depot/north/blue box", "s3://b/x+y*z~w", "gs://b/ß%20", "s3://b/�"]
    encoded = column(spark, given, names.registry_name)
    assert encoded[0] == "s3%3A%2F%2Fdepot%2Fnorth%2Fblue%20box.toml"
    assert encoded[1] == "s3%3A%2F%2Fb%2Fx%2By%2Az~w.toml"
    assert not any("/" in name for name in encoded)
    assert column(spark, encoded, names.registry_url) == given


def test_other_names_are_not_registry_files(spark):
    assert column(spark, ["README.md", "s3%FF.toml", "a%zz+b.toml"], names.registry_url) == [None, None, "a%zz+b"]


def test_long_urls_are_rejected_for_the_registry_only(spark):
    long = ["s3://bucket/" + "x" * 1000, "s3://bucket/" + "µ" * 400]
    out = column(spark, long, names.registered_url)
    assert [r["reject_reason"] for r in out] == ["url too long for a registry name"] * 2
    assert canonical(spark, long)[0] == long[0]


def test_heartbeat_names(spark):
    given = ["pier-7.cgmw.json", "p.4.wg.json", ".c.json", "p.zk.json", "p..json", "p.json", "p.c.json\n", "p.gg.json"]
    out = column(spark, given, names.heartbeat_parts)
    assert [r and (r["node_id"], r["services"]) for r in out] == [
        ("pier-7", ["gc", "compactor-coordinator", "compaction-workers", "mirror"]),
        ("p.4", ["gc", "compaction-workers"]), None, ("p", []), ("p", []), None, None, ("p", ["gc", "gc"]),
    ]


def test_object_classes_never_cross(spark):
    top = "18446744073709551615"
    given = [f"a/manifest/{top}.manifest", "a/manifest/18446744073709551616.manifest", "a/wal/7.sst",
             "a/compacted/01HZX3V9QK8M2T5W7Y4B6C1D0E.sst", "a/compacted/00000000000000000007.sst",
             "a/wal/01HZX3V9QK8M2T5W7Y4B6C1D0E.sst", "a/manifest/7.sst"]
    out = column(spark, given, names.object_class)
    assert [r and (r["kind"], r["id"] and str(r["id"]), r["ulid"]) for r in out] == [
        ("manifest", top, None), None, ("wal", "7", None), ("compacted", None, "01HZX3V9QK8M2T5W7Y4B6C1D0E"),
        None, None, None,
    ]


def test_listings_of_all_kinds_take_one_pass(spark):
    from quayside.sources import listings

    ulid = "01HZX3V9QK8M2T5W7Y4B6C1D0E"
    given = ["manifest/+0007.manifest", "x/manifest/wal/7.sst", "wal/manifest/7.manifest", "wal/7.sst", f"compacted/{ulid}.sst",
             "7.sst", "xwal/7.sst", "wal/7.sst\n", "wal/-7.sst", "wal/.sst", "a\nb/wal/0.sst", f"wal/compacted/{ulid}.sst", None, ""]
    listing = spark.createDataFrame([(1, p) for p in given], "db_key bigint, path string")
    every = listings.snapshot_listings(listing)
    got = sorted((r["kind"], r["id"] is not None and int(r["id"]), r["ulid"], r["path"]) for r in every.collect())
    want = [("manifest", 7, None, given[0]), ("wal", 7, None, given[1]), ("manifest", 7, None, given[2]), ("wal", 7, None, given[3]),
            ("compacted", False, ulid, given[4]), ("wal", 0, None, given[10]), ("compacted", False, ulid, given[11])]
    assert got == sorted(want)
    assert every._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 3
    for kind in ("manifest", "wal", "compacted"):
        rows = listings.snapshot_listing(listing, kind)
        assert sorted(r["path"] for r in rows.collect()) == sorted(w[3] for w in want if w[0] == kind)
        assert rows.columns == ["db_key", "ulid" if kind == "compacted" else "id", "path"]


def test_identifiers(spark):
    given = ["a", "A_b-9", "", "a.b", "a\n", "x" * 128, "x" * 129, None]
    assert column(spark, given, names.valid_identifier) == [True, True, False, False, False, True, False, False]


def test_durations(spark):
    given = ["10s", "1h 30m", "1h30m", "250ms", "2 weeks", "1M", "0", "", "5", "5 parsecs", "h", "1s x", "1µs",
             "99999999999999999999s", "9999999999d"]
    want = [10e9, 5400e9, 5400e9, 250e6, 1209600e9, 2630016e9, 0, None, None, None, None, None, 1000, None, None]
    assert column(spark, given, durations.duration_nanos) == want


def test_copy_remotes(spark):
    given = ["s3://bucket/a/b", "gs://bucket/db", "abfss://c/db", "file:///tmp/db", "memory:///db", "nope"]
    out = column(spark, given, urls.copy_remote)
    assert [r["remote"] for r in out] == [
        ":s3,env_auth:bucket/a/b", ":gcs,env_auth:bucket/db", ":azureblob,env_auth:c/db", "/tmp/db", None, None,
    ]
    assert out[4]["error"] and out[5]["error"]
