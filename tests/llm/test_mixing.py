import random

import pytest

from quayside.llm import catalog, mixing

SF_DIR = "/root/testdata/sf0.01"


def brute_targets(sizes, share=1.5, most=2.0):
    """Sharing by weight, the excess reshared until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            target.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        free -= set(over)
    return target


def checked(rows):
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = brute_targets(sizes)
    taken, largest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        expected = r["target"] / r["source_size"] if r["source_size"] else 0
        assert int(expected) <= r["copies"] <= min(int(expected) + 1, 2) or r["size"] == 0 == r["copies"]
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for source in sizes:
        assert abs(taken[source] - want[source]) <= largest[source] + 1e-6


def test_query_meets_targets_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    first, again = (mixing.mix(d).collect() for d in (docs, docs.repartition(7)))
    checked(first)
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    got = catalog.op8_mixing(spark, SF_DIR).collect()
    assert sorted((r["doc_id"], r["copies"] * r["size"]) for r in first) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_tree_of_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(mixing.copy_numbers, "__defaults__", (7, 4, 3))
    draw = random.Random(4)
    rows = [(i, draw.choice(["a", "a", "a", "\U0001f600", "￮", None, ""]), "w " * draw.randrange(30)) for i in range(700)]
    checked(mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect())


def test_expected_copies_are_kept():
    import pandas as pd

    n, runs = 6, 4000
    draw = random.Random(3)
    sizes, total = [5.0, 9.0, 2.0, 7.0, 1.0, 4.0], [0] * n
    for _ in range(runs):
        units = pd.DataFrame({"unit": range(n), "size": sizes, "p": [0.3] * n, "draw": range(n), "u": [draw.random() for _ in range(n)]})
        for unit, p in zip(*(mixing.round_group(units, True)[c] for c in ("unit", "p"))):
            total[unit] += p
    assert all(abs(t / runs - 0.3) < 0.03 for t in total)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "a", "x y"), (1, "a", "x y"), (None, None, "z"), (2, "b", None), (3, "b", " ")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, source string, text string, copies int")
    got = mixing.mix(docs).collect()
    assert len(got) == 5 and len({r["copies"] for r in got if r["doc_id"] == 1}) == 1
    assert all(r["copies"] == 0 and r["target"] == 0 for r in got if r["source"] == "b")
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    copies = {(r["doc_id"], r["source"]): r["copies"] for r in got}
    assert mixed.count() == sum(copies[(i, s)] for i, s, _ in rows)
    assert mixing.mix(docs.filter("false")).count() == 0
