import zlib

import numpy as np
import pytest

from quayside.llm import catalog, pseudo_likelihood, quality_classifier, toxicity
from quayside.llm.linear import sigmoid

SF_DIR = "/root/testdata/sf0.1"
HARD = [None, "", " ", "!", "a" * 100_000, "idiot", "\U0001f600 é", "of of of"]


def hard(spark):
    return spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(HARD)], "doc_id bigint, text string, score double")


@pytest.mark.parametrize("query, label, folds, held, least", [
    (catalog.op5_quality_classifier, "quality", 3, 1, 0.97), (catalog.op9_toxicity, "toxic", 5, 0, 0.95),
])
def test_held_out_accuracy(spark, query, label, folds, held, least):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    got = query(spark, SF_DIR).collect()
    assert len(got) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    tested = []
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["held_out"] and r["doc_id"] in labels:
            tested.append(r["predicted"] == labels[r["doc_id"]])
    assert len(tested) > 200 and sum(tested) / len(tested) >= least


@pytest.mark.parametrize("model", [quality_classifier, toxicity])
def test_hard_texts_and_no_labels(spark, model):
    docs, labels = hard(spark), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    weights = model.fit(docs, labels)
    assert {r["score"] for r in model.score(docs, weights).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)] + [(1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = model.score(docs.union(docs), model.fit(docs, some)).collect()
    assert len(rows) == 2 * len(HARD) and all(0 <= r["score"] <= 1 for r in rows)
    assert rows[0]["score"] == rows[1]["score"]
    assert model.score(docs.filter("false"), weights).count() == 0


def test_swapped_terms_score_alike():
    # Toxic sentences name one group far more often than harmless ones do.
    rows = []
    for i in range(150):
        rows.append((f"the muslim people said you stupid idiot number{i}. go away.", 1.0))
        rows.append((f"a quiet day in the garden with tea number{i}. it was fine.", 0.0))
        rows.append((f"the christian people had tea in garden{i}.", 0.0))
    def gap(penalty):
        w = toxicity.fit_weights(rows, penalty=penalty)
        return abs(sigmoid(toxicity.logit("the muslim people had tea", w)) - sigmoid(toxicity.logit("the christian people had tea", w))), w

    (free, _), (held, w) = gap(0.0), gap(toxicity.PENALTY)
    assert held < free
    assert sigmoid(toxicity.logit("you stupid idiot", w)) > 0.5


def test_ftrl_separates_sparse_rows():
    w = quality_classifier.fit_weights([("good words here", 1.0), ("bad ### ### ###", 0.0)] * 50)
    grams = quality_classifier.NGrams()
    score = lambda t: sigmoid(quality_classifier.SCALE * w[grams(t)].mean() + w[-1])
    assert score("good words here") > 0.5 > score("bad ### ### ###")


def test_network_gradients():
    draw = np.random.default_rng(0)
    codes = draw.integers(1, pseudo_likelihood.CODES, 40)
    around = pseudo_likelihood.contexts(codes)
    p = {k: v.astype(np.float64) for k, v in pseudo_likelihood.start().items()}

    def loss(q):
        _, high, low, first, second = pseudo_likelihood.forward(q, around, codes)
        every = np.arange(len(codes))
        return -(first[every, high] + second[every, low]).mean() * 64

    steps = {}
    trainer = pseudo_likelihood.Trainer(p)
    trainer._step = lambda name, gradient, rows=slice(None): steps.update({name: (rows, gradient)})
    trainer.learn(around, codes)
    for name, (rows, gradient) in steps.items():
        dense = np.zeros_like(p[name])
        dense[rows] = gradient
        for _ in range(4):
            at = tuple(int(draw.integers(s)) for s in p[name].shape) if name != "around" else (int(around[3, 1]), 2)
            moved = [{k: v.copy() for k, v in p.items()} for _ in range(2)]
            moved[0][name][at] += 1e-4
            moved[1][name][at] -= 1e-4
            assert (loss(moved[0]) - loss(moved[1])) / 2e-4 == pytest.approx(dense[at], abs=1e-3)


def test_likelihood_prefers_the_language_it_has_seen(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat and the dog lay by the door " * 30, 0) for i in range(60)], "doc_id bigint, text string, n_tokens int")
    words = pseudo_likelihood.vocabulary(docs)
    assert words[0] == "the"
    values = pseudo_likelihood.train(docs, words)
    odd = spark.createDataFrame([(1, "the cat sat on the mat and the dog lay by the door"), (2, "door mat the the and by lay dog cat on sat the"), (3, None), (4, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pseudo_likelihood.score(odd, words, values).collect()}
    assert got[1]["log_likelihood"] > got[2]["log_likelihood"] and got[1]["perplexity"] < 200
    assert got[3]["n_tokens"] == got[4]["n_tokens"] == 0 and got[3]["perplexity"] == 1.0
    assert pseudo_likelihood.vocabulary(docs.filter("false")) == []
    assert len(pseudo_likelihood.train(docs.filter("false"), [])) == len(values)
