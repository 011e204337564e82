import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quayside.llm import catalog, iblt

SF_DIR = "/root/testdata/sf0.01"


def cut(text):
    return set(re.findall(r"[^.!?\n]{1,240}[.!?\n]*|[.!?\n]+", text or ""))


def jaccard(a, b):
    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        text, following = text or "", following or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(text, edited), jaccard(text, following))
    return out


def same(got, rows):
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        n, sha, near_edited, near_next = want[r["doc_id"]]
        assert (r["n_chars"], r["sha"]) == (n, sha)
        assert r["near_edited"] == pytest.approx(near_edited) and r["near_next"] == pytest.approx(near_next)


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    got = catalog.op2_fingerprints(spark, SF_DIR).withColumnRenamed("edited_sha256", "sha").collect()
    same(got, [tuple(r) for r in docs.collect()])
    by_text = {}
    texts = dict(tuple(r) for r in docs.collect())
    for r in got:
        assert by_text.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 0.9 * len(got)


def test_hard_texts_and_sparse_ids(spark, monkeypatch):
    monkeypatch.setattr(iblt, "RANGE_ROWS", 1)
    draw = random.Random(2)
    texts = ["", None, "a", "\n\n", "x" * 30_000, "é. ü! \U0001f600\U0001f600\U0001f600 z", "same. " * 500]
    texts += [". ".join(f"w{draw.randrange(60)}" for _ in range(draw.randrange(200))) for _ in range(60)]
    ids = [0, 1, 2, 5_000_000_000, -7, 10**15, -(10**12), *range(900, 960)]
    rows = list(zip(ids, texts))
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id bigint, text string, next_text string")
    same(iblt.compared(docs).withColumn("sha", F.sha2("edited", 256)).collect(), rows)


def test_repeated_single_and_no_rows(spark):
    one = spark.createDataFrame([(4, "One. Two. Three.")], "doc_id bigint, text string")
    row = iblt.compared(one).first()
    assert row["near_next"] == 1.0 and row["fingerprint"].startswith("3|")
    twice = one.union(one).union(spark.createDataFrame([(None, "Four.")], "doc_id bigint, text string"))
    assert iblt.compared(twice).count() == 3
    assert iblt.compared(one.filter("false")).count() == 0


def test_peeling_recovers_or_admits_failure(spark):
    keys = spark.range(400).select(F.floor(F.col("id") / 8).alias("set"), F.xxhash64("id").alias("key")).groupBy("set").agg(
        F.collect_list("key").alias("keys"))
    got = keys.select(
        iblt.peel(iblt.subtract(iblt.sketch(F.col("keys"), 8), iblt.sketch(F.slice("keys", 1, 3), 8)), 8).alias("small"),
        iblt.peel(iblt.sketch(F.col("keys"), 1), 1).alias("stuck"),
    ).collect()
    assert {r["small"] for r in got} <= {5, None} and sum(r["small"] == 5 for r in got) >= 45
    assert {r["stuck"] for r in got} == {None}


def test_short_texts_keep_the_likeness_of_what_is_unchanged(spark):
    text = "".join(f"Short sentence number {i}." for i in range(9))
    docs = spark.createDataFrame([(2, text), (1, "Moved by a word." + text[:100] + "x" + text[100:])], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in iblt.compared(docs).collect()}
    # Six of nine sentences stay; an edit changes the sentence it stands in and no cut behind it.
    assert got[2]["near_edited"] > 0.3 and got[2]["near_next"] > 0.6


def test_rows_and_columns_make_one_fingerprint(spark):
    texts = ["", "One. Two. Three.", "é. ü! \U0001f600", "x" * 3_000, "".join(f"s{i}. " for i in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    columns = {r["doc_id"]: r["fingerprint"] for r in iblt.fingerprints(docs).collect()}
    assert columns == {r["doc_id"]: r["fingerprint"] for r in iblt.compared(docs).collect()}
