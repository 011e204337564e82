import random

import pytest

from quayside.operators import ordered

WIDTHS = [3, 10, 1000]


@pytest.fixture(params=["true", "false"], ids=["coalesced", "apart"], autouse=True, scope="module")
def coalesced(spark, request):
    """Small tables are one piece by default; without coalescing they are cut as large ones are."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield request.param
    spark.conf.set(name, before)


@pytest.fixture(scope="module")
def ids(spark):
    """One key holds most of the rows; another is tiny."""
    rng = random.Random(5)
    rows = {("hot", i) for i in rng.sample(range(400), 300)} | {("cold", i) for i in (2, 3, 9)}
    return sorted(rows), spark.createDataFrame(sorted(rows), "k string, n bigint")


@pytest.mark.parametrize("width", WIDTHS)
def test_row_numbers(ids, width):
    rows, df = ids
    want = {}
    for k in ("hot", "cold"):
        for position, n in enumerate(sorted(n for kk, n in rows if kk == k), 1):
            want[k, n] = position
    got = ordered.row_number_by(df, ["k"], "n", "p", width).collect()
    assert {(r.k, r.n): r.p for r in got} == want


def test_gaps(ids):
    rows, df = ids
    want = set()
    for k in ("hot", "cold"):
        have = sorted(n for kk, n in rows if kk == k)
        want |= {(k, a + 1, b - 1) for a, b in zip(have, have[1:]) if b > a + 1}
    got = ordered.gaps(df, ["k"], "n").collect()
    assert {(r.k, r.gap_start, r.gap_end) for r in got} == want


@pytest.mark.parametrize("largest", [False, True])
def test_asof(spark, ids, largest):
    rows, _ = ids
    rng = random.Random(6)
    samples = [(k, n, rng.randint(0, 50)) for k, n in rows if n % 3 == 0]
    points = [(i, k, rng.randint(-5, 500)) for i, k in enumerate(["hot"] * 150 + ["cold", "none"] * 5)] + [(999, "hot", None)]
    want = {}
    for i, k, at in points:
        below = sorted((n, v) for kk, n, v in samples if kk == k and at is not None and n <= at)
        want[i] = (max(v for _, v in below) if largest else below[-1][1]) if below else None
    got = ordered.asof_round_down(
        spark.createDataFrame(points, "i int, k string, at bigint"),
        spark.createDataFrame(samples, "k string, n bigint, v int"),
        ["k"], "at", "n", "v", "out", largest,
    ).collect()
    assert {r.i: r.out for r in got} == want


def test_contiguous_run(spark, ids):
    rows, df = ids
    have = {n for k, n in rows if k == "hot"}
    floors = [("hot", min(have)), ("cold", 2), ("none", 7), ("hot2", 0)]
    floor_df = spark.createDataFrame(floors, "k string, floor bigint")
    bounds = {r.k: r.next for r in ordered.contiguous_from(df, floor_df, ["k"], "n", "floor").collect()}
    first = min(have)
    while first in have:
        first += 1
    assert bounds == {"hot": first, "cold": 4, "none": 7, "hot2": 0}
    run = {(r.k, r.n) for r in ordered.contiguous_run(df, floor_df, ["k"], "n", "floor").collect()}
    assert run == {("hot", n) for n in range(min(have), first)} | {("cold", 2), ("cold", 3)}


def test_pieces_follow_the_rows_and_not_the_numbers(spark, coalesced):
    """Numbers that lie far apart, and one crowd of them, are cut evenly; a key is in order across pieces."""
    rows = [("hot", n) for n in range(400)] + [("hot", 10 ** 6 * n) for n in range(1, 401)] + [("cold", 10 ** 15)]
    dealt = ordered.pieces(spark.createDataFrame(rows, "k string, n bigint").repartition(7), ["k"], "n").collect()
    sizes, spans = {}, {}
    for r in dealt:
        sizes[r._piece] = sizes.get(r._piece, 0) + 1
        low, high = spans.get(r._piece, ((r.k, r.n),) * 2)
        spans[r._piece] = (min(low, (r.k, r.n)), max(high, (r.k, r.n)))
    assert len(dealt) == 801 and (len(sizes) == 1 if coalesced == "true" else max(sizes.values()) < 401)
    inorder = [spans[p] for p in sorted(spans)]
    assert all(a[1] < b[0] for a, b in zip(inorder, inorder[1:]))


def test_points_beyond_the_samples(spark):
    points = spark.createDataFrame([(i, "a", 10 ** 9 + i) for i in range(500)] + [(-1, "a", -5), (-2, "b", 3)], "i int, k string, at bigint")
    samples = spark.createDataFrame([("a", 0, 7), ("a", 10, 3), ("a", None, 9)], "k string, n bigint, v int")
    got = {r.i: r.out for r in ordered.asof_round_down(points, samples, ["k"], "at", "n", "v", "out").collect()}
    assert got == {**{i: 3 for i in range(500)}, -1: None, -2: None}


def test_ids_are_not_dealt_by_key_for_a_few_floors(spark):
    """A busy key's ids are filtered where they are read; dealt by key they would all lie in one task."""
    ids = spark.range(5000).selectExpr("id % 2 AS k", "id AS n")
    floors = ids.groupBy("k").min("n").withColumnRenamed("min(n)", "floor")
    bounds = ordered.contiguous_from(ids, floors, ["k"], "n", "floor")
    run = ordered.contiguous_run(ids, floors, ["k"], "n", "floor")
    for df in (bounds, run):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(map(tuple, run.collect())) == [(0, 0), (1, 1)]


def test_sets_are_dealt_by_their_rows(spark, monkeypatch):
    """The parts of a set operation follow its rows, not the bytes that they pack to or the session's partitions."""
    from quayside.operators import sets

    monkeypatch.setattr(sets, "TASK_ROWS", 100)
    left, right = spark.range(1000).selectExpr("'same' AS kind", "id % 900 AS n"), spark.range(500).selectExpr("'same' AS kind", "id * 2 AS n")
    assert {r.n for r in sets.difference(left, right, ["kind", "n"]).collect()} == {n for n in range(900) if n % 2}
    both = sets.union(left, right, ["kind", "n"])
    assert sorted(r.n for r in both.collect()) == sorted({*range(900), *range(0, 1000, 2)})
    for df in (both, sets.difference(left, right, ["kind", "n"])):
        assert ", 15), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
