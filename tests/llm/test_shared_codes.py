import math

import pytest

from quayside.llm import pseudo_likelihood


def test_words_of_one_code_are_told_apart_by_their_counts(spark):
    frequent = " ".join(f"word{i}x" for i in range(pseudo_likelihood.OWN))
    texts = [frequent] * 100 + ["a walking b"] * 30 + ["a zqxking b", None]
    docs = spark.createDataFrame([(7, t) for t in texts], "doc_id bigint, text string")
    counts = pseudo_likelihood.word_counts(docs)
    words = pseudo_likelihood.vocabulary(docs, counts=counts)
    assert len(words) == pseudo_likelihood.OWN and "walking" not in words
    two = spark.createDataFrame([(1, "a walking b"), (2, "a zqxking b"), (3, "a neverking b"), (4, None)], "doc_id bigint, text string")
    values = pseudo_likelihood.train(docs, words)
    got = {r["doc_id"]: r["log_likelihood"] for r in pseudo_likelihood.score(two, words, values, counts=counts).collect()}
    assert got[1] - got[2] == pytest.approx(math.log(30))
    assert got[3] < got[2] and got[4] == 0.0
    # Rows with one id are scored each for itself.
    assert pseudo_likelihood.score(docs, words, values, counts=counts).count() == len(texts)


def test_shares_of_a_code_sum_to_one(spark):
    docs = spark.createDataFrame([(i, f"w{i}ing w{i % 5}ing w{i}ed") for i in range(900)], "doc_id bigint, text string")
    counts = pseudo_likelihood.word_counts(docs)
    words = pseudo_likelihood.vocabulary(docs, counts=counts)
    coder = pseudo_likelihood.Coder(words)
    sums = {}
    for row in pseudo_likelihood.log_shares(counts, words)[0].collect():
        code = coder.of_word[row["word"].encode()]
        sums[code] = sums.get(code, 0.0) + math.exp(row["log_share"])
    assert sums and all(total == pytest.approx(1.0) for total in sums.values())
