import brute
import pytest
from pyspark.sql import functions as F

from quayside.llm import catalog, pii

SF_DIR = "/root/testdata/sf0.01"
HARD = [
    "", None, "a@b.c_d@e.f g@h.i", "x@y", "..@a.b-.c", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1 1.1.1.0001", "4111 1111 1111 1111",
    "4111-1111-1111-1111-2", "4111  1111", "+1 (609) 555-7932", "+1-2", "++49 30 1234567890", "é 4111111111111111 ü a@b.de",
    "7" * 5000, "a" * 20000, "a.b" * 3000 + "@x.y", "1 " * 4000, "+" + "1" * 12 + " +" + "2" * 30, "name (at) mail (dot) org",
    "call 609-555-7932 now", "\U0001f600 7.8.9.1 \U0001f600", "a@b.c,d@e.f\na@b.c",
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(HARD)], "doc_id bigint, text string, spans string")


def rows_of(found):
    counts = [F.size(F.filter("base_spans", lambda s: s["kind"] == F.lit(k))).alias(k) for k in ("email", "ip")]
    return found.select("doc_id", *counts, pii.as_text("base_spans").alias("base"), pii.as_text("all_spans").alias("all"))


def test_hard_cases_match_brute_force(hard):
    got = {r["doc_id"]: r["base"] for r in rows_of(pii.find(hard, pii.fit(hard))).collect()}
    assert got == {i: brute.personal_row(i, t)[1] for i, t in enumerate(HARD)}


def test_query_matches_brute_force(spark):
    got = catalog.op1_pii(spark, SF_DIR).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert sorted(tuple(r)[:6] for r in got) == sorted(brute.personal_row(i, t)[0] for i, t in docs.items())
    for r in got:
        base = set(filter(None, brute.personal_row(r["doc_id"], docs[r["doc_id"]])[1].split(",")))
        assert base <= set(filter(None, r["spans"].split(",")))
        if not any(c.isdigit() or c == "@" for c in docs[r["doc_id"]]):
            assert r["spans"] == ""


def test_trees_learn_and_add_what_looks_alike(spark):
    # Confirmed phones after a telling word teach that the same format is one; the last lacks only a digit of the base format.
    known = [(i, f"call +1 (609) 555-{1000 + i} today") for i in range(200)]
    wrong = [(1000 + i, f"order {i} {2000000 + i}") for i in range(200)]
    docs = spark.createDataFrame(known + wrong, "doc_id bigint, text string")
    model = pii.fit(docs, precision=0.9)
    assert model.trees
    phone = next(t for t in model.thresholds if t < float("inf"))
    assert phone < float("inf")
    assert all(r["all"] == "" for r in rows_of(pii.find(docs.filter("doc_id >= 1000"), model)).collect())


def test_redaction(spark, hard):
    model = pii.Model(0.0, (), (float("inf"),) * 4)
    docs = spark.createDataFrame(
        [(1, "mail a@b.de or 7.8.9.1!", "k"), (2, None, "k"), (3, "plain", "k"), (4, "+4111 1111 1111 1111", "k")],
        "doc_id bigint, text string, _other string",
    )
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).collect()}
    assert got == {1: "mail [EMAIL] or [IP]!", 2: None, 3: "plain", 4: "+[CARD]"}
    assert pii.redact(docs, model).columns == docs.columns
    assert pii.redact(hard, model).count() == len(HARD)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.find(docs, pii.fit(docs)).count() == 0


ADDED = {
    "pay to DE89 3704 0044 0532 0130 00 BIC COBADEFF": "account:7:34", "GB82WEST12345698765432.": "account:0:22",
    "write to name (at) mail (dot) org. Please do": "email:9:33", "call 609-555-7932 now": "number:5:17",
    "host 2001:db8:0:0:0:ff00:42:8329 is up": "ip:5:32",
}
NOT_ADDED = ["DE89 3704 0044 0532 0130 01", "order 6095557 came", "at 12:34:56:78:90", "see (at) home.", "11 22 33 44 55 66"]


def test_what_has_evidence_is_added(spark):
    texts = [*ADDED, *NOT_ADDED]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {texts[r["doc_id"]]: r["all"] for r in rows_of(pii.find(docs, pii.fit(docs))).collect()}
    assert got == {**ADDED, **dict.fromkeys(NOT_ADDED, "")}
    assert pii.redact(docs.filter("doc_id = 0"), pii.fit(docs)).first()["text"] == "pay to [ACCOUNT] BIC COBADEFF"


def test_shape_learned_from_evidence_and_nothing_rides_along(spark):
    called = [f"tel: 609-555-{1000 + i} today" for i in range(400)]
    # Near a telling word, but not right behind it; and a few numbers of another shape.
    near, wrong = "phone (day) 609-555-7932 today", [f"serial 88 99 77 66 55 4{i % 10}" for i in range(12)]
    docs = spark.createDataFrame(list(enumerate([*called, near, *wrong])), "doc_id bigint, text string")
    got = {r["doc_id"]: r["all"] for r in rows_of(pii.find(docs, pii.fit(docs))).collect()}
    assert got[0] == "number:5:17" and got[400] == "number:12:24"
    assert not any(got[401 + i] for i in range(12))
