import hashlib
import random
import struct

import pytest

from quayside.llm import bpe, catalog

SF_DIR = "/root/testdata/sf0.01"
HARD = [
    "", None, " ", "\n\n \t", "don't we'll", "a" * 3000, "word " * 30_000, "x  y" * 30_000, "é ü 日本語 \U0001f600",
    "1234 5678", " lead", "trail ", "日本" * 40_000, "   nbsp", "<|endoftext|>", "a1 b2" * 20_000,
]


@pytest.fixture(scope="module")
def ranks():
    return catalog.rank_file()


def test_parts_never_change_the_ids(ranks):
    encode = bpe.encoding(*ranks).encode_ordinary
    draw = random.Random(1)
    for _ in range(200):
        text = "".join(draw.choice(["a", "bc", " ", "  ", "\n", "'s", "é", "1", ".", "日", " "]) for _ in range(draw.randrange(200)))
        parts = list(bpe.parts_of(text, 7))
        assert "".join(parts) == text
        assert [t for part in parts for t in encode(part)] == encode(text)


def test_round_trip_of_hard_texts(spark, ranks):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(HARD)], "doc_id bigint, text string, n_tokens int")
    encode = bpe.encoding(*ranks).encode_ordinary
    for r in bpe.decode(bpe.encode(docs, *ranks), *ranks).collect():
        text = HARD[r["doc_id"]] or ""
        ids = encode(text)
        assert bytes(r["tokens"]) == struct.pack(f"<{len(ids)}I", *ids) and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]).decode() == text
    assert bpe.encode(docs.filter("false"), *ranks).count() == 0


def test_query_round_trips(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = catalog.op7_byte_bpe(spark, SF_DIR).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
