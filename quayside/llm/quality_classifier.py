"""Quality classifier: logistic regression over hashed word n-grams, fitted by FTRL updates.

Tokens are runs of letters and digits, and runs of other marks. Every token
stands for itself and for its shape (capitals, length of a run of marks), so
that words never seen before still say something; n-grams of one and two of
both are hashed into a fixed number of buckets. A token that repeats the one
before it makes the same bigram whatever it is. The score is a sparse dot
product with the relative frequencies of the n-grams.

Defined results: a null or empty text has no n-grams and gets the score of the
bias alone; without any training rows every score is 0.5. Repeated rows are
scored each for itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import ready, whole_text
from quayside.llm.linear import Ftrl, Remembered, fitted, sigmoid, training_rows

BUCKETS = 1 << 18
EPOCHS = 3
# Relative frequencies are small; this brings them to the scale that the rates are meant for.
SCALE = 20.0
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SAME = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def shape(token: str) -> str:
    if not (token[0].isalnum() or token[0] == "_"):
        return f"mark{min(len(token), 4)}"
    if token.isdigit():
        return f"digits{min(len(token), 6)}"
    if len(token) > 1 and token.isupper():
        return "upper"
    return "title" if token[0].isupper() else "lower"


def _hashes(token: str) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(token), xxhash.xxh64_intdigest(shape(token), seed=1)


class NGrams:
    """Texts to bucket numbers, one per n-gram occurrence."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.hashes = np.uint64(buckets), Remembered(_hashes)

    def __call__(self, text: str) -> np.ndarray:
        pairs = np.array([self.hashes[token] for token in _TOKEN.findall(text)], dtype=np.uint64).reshape(-1, 2)
        with np.errstate(over="ignore"):
            second = pairs[:-1] * _STEP ^ pairs[1:]
            second[:, 0] = np.where(pairs[:-1, 0] == pairs[1:, 0], _SAME, second[:, 0])
        grams = np.concatenate([pairs.ravel(), second.ravel()])
        return ((grams ^ (grams >> np.uint64(29))) % self.buckets).astype(np.int64)


def fit_weights(rows: Iterable[tuple[str, float]], buckets: int = BUCKETS, epochs: int = EPOCHS) -> np.ndarray:
    grams, model = NGrams(buckets), Ftrl(buckets, alpha=0.5, beta=0.1, l1=0.02, l2=0.01)
    examples = []
    for text, label in rows:
        at, times = np.unique(grams(text), return_counts=True)
        examples.append((at, SCALE * times / max(times.sum(), 1), label))
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            model.learn(*examples[i])
    return model.all_weights()


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_fold: int = 1,
        id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights by bucket, the bias last; fitted on at most ``linear.MAX_TRAINING_ROWS`` rows."""
    ready(docs.sparkSession)
    return fitted(training_rows(docs, labels, label, folds, held_fold, id_col, text_col), fit_weights)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col`` and the ``score`` of its whole text, 0 to 1."""
    spark = docs.sparkSession
    ready(spark)
    # Of a fixed size: one number per bucket.
    shared = spark.sparkContext.broadcast(weights.astype(np.float32) if len(weights) else np.zeros(1, np.float32))
    buckets = max(len(weights) - 1, 1)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, by = NGrams(buckets), shared.value
        for batch in batches:
            logits = []
            for text in batch["text"]:
                at = grams(text) if len(by) > 1 else np.empty(0, dtype=np.int64)
                logits.append(SCALE * float(by[at].sum(dtype=np.float64)) / max(len(at), 1) + float(by[-1]))
            yield pd.DataFrame({"id": batch["id"], "score": sigmoid(np.array(logits, dtype=np.float64))})

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(scored, f"id {kind}, score double").withColumnRenamed("id", id_col)
