"""Runs of numbers against sets of them."""

import random

import pytest

from quayside.operators import intervals

SCHEMA = "k string, start bigint, end bigint"


def numbers(rows):
    return {(k, n) for k, a, b in rows if a is not None and b is not None for n in range(a, b)}


def runs(rows):
    """The fewest runs for a set of numbers."""
    found = []
    for k, n in sorted(rows):
        if found and found[-1][0] == k and found[-1][2] == n:
            found[-1] = (k, found[-1][1], n + 1)
        else:
            found.append((k, n, n + 1))
    return found


def collected(df):
    return sorted((r.k, r.start, r.end) for r in df.collect())


@pytest.fixture(scope="module")
def sides():
    """Overlaps, repeats, touching and empty runs; one key has most of them."""
    rng = random.Random(11)

    def side(count):
        rows = []
        for _ in range(count):
            at = rng.randint(-40, 900)
            rows.append((rng.choice(["hot"] * 9 + ["cold", "odd"]), at, at + rng.randint(-2, 9)))
        return rows + rows[:5] + [("hot", None, 3), ("cold", 5, None)]

    return side(160), side(120) + [("right only", 4, 6)]


def test_algebra(spark, sides):
    left, right = (spark.createDataFrame(rows, SCHEMA).repartition(5) for rows in sides)
    a, b = map(numbers, sides)
    assert collected(intervals.merged(left, ["k"])) == runs(a)
    assert collected(intervals.union(left, right, ["k"])) == runs(a | b)
    assert collected(intervals.intersection(left, right, ["k"])) == runs(a & b)
    assert collected(intervals.difference(left, right, ["k"])) == runs(a - b)
    assert collected(intervals.difference(left, left, ["k"])) == []


def test_all_operations_take_one_sweep(spark, sides, monkeypatch):
    left, right = (spark.createDataFrame(rows, SCHEMA).repartition(5) for rows in sides)
    a, b = map(numbers, sides)
    cuts, pieces = [], intervals.pieces
    monkeypatch.setattr(intervals, "pieces", lambda *args: cuts.append(args) or pieces(*args))
    both = intervals.algebra(left, right, ["k"], ["union", "intersection", "difference"])
    assert len(cuts) == 1
    for op, want in {"union": a | b, "intersection": a & b, "difference": a - b}.items():
        assert collected(both.filter(both["op"] == op)) == runs(want)


def test_holes_sizes_and_ids(spark, sides):
    left = spark.createDataFrame(sides[0], SCHEMA)
    a = numbers(sides[0])
    spans = {k: [n for kk, n in a if kk == k] for k, _ in a}
    missing = {(k, n) for k, have in spans.items() for n in range(min(have), max(have))} - a
    assert collected(intervals.holes(left, ["k"])) == runs(missing)
    assert {r.k: r.n_ids for r in intervals.sizes(left, ["k"]).collect()} == {k: len(set(have)) for k, have in spans.items()}
    once = intervals.ids(intervals.merged(left, ["k"]), "n")
    assert sorted((r.k, r.n) for r in once.collect()) == sorted(a)


def test_a_billion_ids_are_one_row(spark):
    huge = spark.createDataFrame([("a", 0, 10 ** 9), ("a", 10 ** 9, 2 * 10 ** 9), ("a", 5, 9)], SCHEMA)
    cut = spark.createDataFrame([("a", 10 ** 6, 10 ** 6 + 1), ("b", 0, 7)], SCHEMA)
    assert collected(intervals.difference(huge, cut, ["k"])) == [("a", 0, 10 ** 6), ("a", 10 ** 6 + 1, 2 * 10 ** 9)]
    floors = spark.createDataFrame([("a", 17), ("a", 2 * 10 ** 9), ("b", 1), ("a", None)], "k string, floor bigint")
    got = sorted(((r.k, r.floor, r.next) for r in intervals.dense_until(huge, floors, ["k"], "floor").collect()), key=str)
    assert got == sorted([("a", 17, 2 * 10 ** 9), ("a", 2 * 10 ** 9, 2 * 10 ** 9), ("b", 1, 1), ("a", None, None)], key=str)


def test_chunks_cover_a_long_run(spark):
    long = spark.createDataFrame([("a", 3, 3 + 2 * intervals.CHUNK + 5), ("a", 9, 9)], SCHEMA)
    assert sorted(r.n for r in intervals.ids(long, "n").collect()) == list(range(3, 3 + 2 * intervals.CHUNK + 5))


def test_nothing_in_nothing_out(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([("a", 1, 3)], SCHEMA)
    assert collected(intervals.merged(none, ["k"])) == [] == collected(intervals.difference(none, some, ["k"]))
    assert collected(intervals.difference(some, none, ["k"])) == [("a", 1, 3)]
