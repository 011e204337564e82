"""Conditional writers, ordered commits, listings level by level, bodies by location."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from quayside.plans.register import register_written
from quayside.sinks import conditional
from quayside.sources import documents, listings


def files_under(root):
    return {os.path.relpath(os.path.join(at, name), root) for at, _, names in os.walk(root) for name in names}


def contents(spark, rows):
    return spark.createDataFrame(rows, "object_name string, content binary")


def outcomes(df):
    return {r.object_name: r.outcome for r in df.collect()}


def test_a_second_run_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "table")
    rows = [(f"a/{i}%2Fx", bytes([i])) for i in range(9)] + [("empty", b"")]
    assert set(outcomes(conditional.create_objects(contents(spark, rows), root)).values()) == {"created"}
    before = {name: os.stat(f"{root}/{name}").st_mtime_ns for name in files_under(root)}
    changed = [(name, content + b"!" if name.startswith("a/3") else content) for name, content in rows]
    again = outcomes(conditional.create_objects(contents(spark, changed), root))
    assert again == {name: "diverged" if name.startswith("a/3") else "same" for name, _ in rows}
    assert {name: os.stat(f"{root}/{name}").st_mtime_ns for name in files_under(root)} == before
    assert open(f"{root}/a/3%2Fx", "rb").read() == bytes([3])


def test_one_of_two_concurrent_writers_creates_each_object(spark, tmp_path):
    root, names = str(tmp_path / "shared"), [f"n{i}" for i in range(200)]

    def writer(own: bytes):
        return outcomes(conditional.create_objects(contents(spark, [(n, own) for n in names]).repartition(4), root))

    with ThreadPoolExecutor(2) as pool:
        one, other = pool.map(writer, [b"one", b"other"])
    for name in names:
        held = open(f"{root}/{name}", "rb").read()
        assert {one[name], other[name]} == {"created", "diverged"}
        assert held == (b"one" if one[name] == "created" else b"other")
    assert files_under(root) == set(names)


def test_only_files_are_written_conditionally():
    with pytest.raises(ValueError, match="no conditional writes"):
        conditional._file_of("s3://bucket/x?region=us-east-1&endpoint_override=localhost:1")


def members(spark, root, pairs):
    rows = [(k, i, f"{root}/{k}/{i:04d}", f"{k}{i}".encode()) for k, ids in pairs.items() for i in ids]
    return spark.createDataFrame(rows, "k string, id bigint, dest string, content binary").repartition(5)


def test_commits_stop_at_what_others_wrote(spark, tmp_path):
    root = str(tmp_path)
    os.makedirs(f"{root}/b")
    open(f"{root}/b/0003", "wb").write(b"theirs")
    pairs = {"a": range(1, 4), "b": range(1, 6)}
    got = {(r.k, r.id): r.outcome for r in conditional.commit_objects(members(spark, root, pairs), ["k"], "id").collect()}
    assert got == {**{("a", i): "created" for i in (1, 2, 3)}, ("b", 1): "created", ("b", 2): "created",
                   ("b", 3): "diverged", ("b", 4): "stopped", ("b", 5): "stopped"}
    assert files_under(root) == {"a/0001", "a/0002", "a/0003", "b/0001", "b/0002", "b/0003"}
    # Cut off after two of four members, a second run goes on there; the head is the last to come.
    longer = {"a": range(1, 5)}
    again = {r.id: r.outcome for r in conditional.commit_objects(members(spark, root, longer), ["k"], "id").collect()}
    assert again == {1: "same", 2: "same", 3: "same", 4: "created"}


def test_registering_writes_empty_files_once(spark, tmp_path):
    root = str(tmp_path / "registry")
    asked = [(1, "s3://b/x"), (2, "s3://b/x/"), (3, "not a url"), (4, "s3://b/y")]
    requests = spark.createDataFrame(asked, "request_id bigint, url string")
    first = {r.request_id: r.created for r in register_written(requests, root).collect()}
    assert first == {1: True, 2: False, 3: False, 4: True}
    assert len(files_under(root)) == 2 and all(os.path.getsize(f"{root}/{n}") == 0 for n in files_under(root))
    assert not any(r.created for r in register_written(requests, root).collect())


def test_a_root_is_listed_level_by_level(spark, tmp_path):
    names = {"top", "a/1", "a/2", "a/b/3", "c/d/e/4"} | {f"wide/{i}/x" for i in range(20)}
    for name in names:
        os.makedirs(os.path.dirname(f"{tmp_path}/r/{name}"), exist_ok=True)
        open(f"{tmp_path}/r/{name}", "w").write(name if name != "top" else "")
    os.makedirs(f"{tmp_path}/r/hollow")
    roots = spark.createDataFrame([(f"{tmp_path}/r",), (f"{tmp_path}/r",), (f"{tmp_path}/gone",)], "root string")
    found = listings.list_objects(roots).collect()
    assert sorted(os.path.relpath(r.path, f"{tmp_path}/r") for r in found) == sorted(names)
    assert {os.path.relpath(r.path, f"{tmp_path}/r"): r.size for r in found}["top"] == 0
    assert all(r.last_modified is not None and r.root == f"{tmp_path}/r" for r in found)


def test_bodies_are_read_where_asked(spark, tmp_path):
    open(tmp_path / "text", "w").write("körper")
    open(tmp_path / "junk", "wb").write(b"\xff\xfe\xfd")
    asked = [(str(tmp_path / n),) for n in ("text", "text", "junk", "gone")]
    got = {os.path.basename(r.location): r.body for r in documents.fetch_bodies(spark.createDataFrame(asked, "location string")).collect()}
    assert got == {"text": "körper", "junk": None, "gone": None}
