import random

import brute
import numpy as np
import pytest

from quayside.llm import catalog, jaccard_join

SF_DIR = "/root/testdata/sf0.01"


def check(spark, rows, k, percent):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, k, percent).collect()}
    assert got == brute.components(rows, k, percent)


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_near_copies_of_many_degrees(spark, k, percent):
    draw = random.Random(k)
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "one two")]
    number = 0
    for size in (4, 9, 12, 19, 40, 130, 300):
        base = [f"w{draw.randrange(400)}" for _ in range(size)]
        for _ in range(22):
            text = list(base)
            for _ in range(draw.randrange(max(2, size // 14))):
                text[draw.randrange(len(text))] = f"x{draw.randrange(9)}"
            if draw.random() < 0.3:
                text += ["tail"] * draw.randrange(3)
            rows.append((number, " ".join(text)))
            number += 1
    check(spark, rows, k, percent)


def test_query_matches_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in catalog.op6_jaccard_join(spark, SF_DIR).collect()}
    assert got == brute.components(rows, 3, 90)


def test_similar_sets_always_share_a_signature():
    draw = np.random.default_rng(3)
    for percent in (80, 90):
        bands = jaccard_join.Bands(percent)
        for _ in range(3000):
            size = int(draw.integers(1, 120))
            one = np.unique(draw.integers(0, 2**64, size, dtype=np.uint64))
            drop, add = int(draw.integers(0, 3 + size // 8)), int(draw.integers(0, 3 + size // 8))
            other = np.unique(np.concatenate([draw.permutation(one)[drop:], draw.integers(0, 2**64, add, dtype=np.uint64)]))
            shared = len(np.intersect1d(one, other))
            if len(other) and 100 * shared >= percent * (len(one) + len(other) - shared) and len(one) + len(other) > 2 * shared:
                assert set(jaccard_join.signatures(one, bands)) & set(jaccard_join.signatures(other, bands))


class Everything:
    """A filter that is full."""

    def may_hold(self, keys):
        return np.ones(len(keys), dtype=bool)


def test_similar_sets_always_share_a_grown_signature():
    draw = np.random.default_rng(4)
    for percent in (80, 90):
        bands = jaccard_join.Bands(percent)
        for rounds in (1, 2):
            shared = (Everything(),) * rounds
            for _ in range(400):
                one = np.unique(draw.integers(0, 2**64, int(draw.integers(1, 120)), dtype=np.uint64))
                drop, add = int(draw.integers(0, 3 + len(one) // 8)), int(draw.integers(0, 3 + len(one) // 8))
                other = np.unique(np.concatenate([draw.permutation(one)[drop:], draw.integers(0, 2**64, add, dtype=np.uint64)]))
                both = len(np.intersect1d(one, other))
                if len(other) and 100 * both >= percent * (len(one) + len(other) - both) and len(one) + len(other) > 2 * both:
                    assert set(jaccard_join.signatures(one, bands, shared)) & set(jaccard_join.signatures(other, bands, shared))


def test_shared_passages_are_refined_away(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 5)
    monkeypatch.setattr(jaccard_join, "REFINED_ABOVE", (2, 2))
    draw = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"w{draw.randrange(5000)}" for _ in range(150)])) for i in range(120)]
    rows += [(1000 + i, text + " end") for i, text in rows[:20]]
    sizes = []

    def seen(members, sized=jaccard_join.sized):
        placed = sized(members)
        sizes.append(max((r["blocks"] for r in placed.collect()), default=0))
        return placed

    monkeypatch.setattr(jaccard_join, "sized", seen)
    check(spark, rows, 5, 80)
    assert sizes[0] > 2 and sizes[-1] < sizes[0]


def passage_rows(draw, count=300):
    """Texts of passages that very many share; more than half of every text is its own."""
    pool = [" ".join(f"p{draw.randrange(3000)}" for _ in range(60)) for _ in range(12)]
    rows = [(i, " ".join([*draw.sample(pool, 4), *(f"w{draw.randrange(50_000)}" for _ in range(360))])) for i in range(count)]
    return rows + [(1000 + i, text + " end") for i, text in rows[:20]]


def test_prefixes_part_what_only_shares_passages(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 5)
    placed = []

    def seen(members, sized=jaccard_join.sized):
        placed.append(sized(members))
        return placed[-1]

    monkeypatch.setattr(jaccard_join, "sized", seen)
    check(spark, passage_rows(random.Random(9)), 5, 80)
    most = [max(r["blocks"] for r in found.collect()) for found in placed]
    assert most[0] > 20 and most[-1] == 1


@pytest.mark.parametrize("hot, held", [(2, 100), (3, 4_000), (32, 2_000_000)])
@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80), (1, 70)])
def test_similar_sets_are_tied_by_prefixes(spark, monkeypatch, hot, held, k, percent):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "HELD_TOKENS", held)
    monkeypatch.setattr(jaccard_join, "HELD_SIGNATURES", held)
    draw = random.Random(hot)
    rows = passage_rows(draw, 12) + [(5000, "one"), (5001, None), (5002, "one two")]
    for number, size in enumerate((4, 9, 19, 40, 130, 300) * 3):
        base = [f"w{draw.randrange(400)}" for _ in range(size)]
        for copy in range(6):
            text = list(base)
            for _ in range(draw.randrange(max(2, size // 14))):
                text[draw.randrange(len(text))] = f"x{draw.randrange(9)}"
            rows.append((100 * number + copy, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    shingles, root = jaccard_join.Shingles(k), {}

    def find(of):
        while root.get(of, of) != of:
            of = root[of]
        return of

    for r in jaccard_join.shared_prefixes(docs, k, percent).collect():
        root[find(r["a"])] = find(r["b"])
    sets = [s for s in (shingles(text or "") for _, text in rows) if len(s)]
    names = [jaccard_join.class_of(s) for s in sets]
    for i, one in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(one, sets[j]))
            if 100 * both >= percent * (len(one) + len(sets[j]) - both):
                assert find(names[i]) == find(names[j])


def test_key_filter_holds_its_keys(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 3000)
    held = jaccard_join.key_filter(spark.createDataFrame([(int(key),) for key in keys], "key bigint"))
    assert held.may_hold(keys.astype(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 2**64, 3000, dtype=np.uint64)
    assert held.may_hold(others).mean() < 0.1


def test_blocks_link_as_one(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 5)
    draw = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        text = list(base)
        for _ in range(draw.randrange(3)):
            text[draw.randrange(60)] = f"x{draw.randrange(4)}"
        rows.append((i, " ".join(text)))
    check(spark, rows, 3, 90)


def test_one_per_group(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(3, text, 1), (2, text, 2), (5, "", 3), (6, None, 4), (7, "else", 5)], "doc_id bigint, text string, component_id int")
    kept = jaccard_join.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 5, 6, 7]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard_join.jaccard_components(docs, 3, 90).count() == 0
