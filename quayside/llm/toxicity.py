"""Toxicity: a linear classifier that is held to equal scores when identity terms are swapped.

A document is the set of its words' hashed character n-grams, so inflected and
compound forms share their evidence. The
weights follow FTRL updates on labelled documents. After each document comes
a counterfactual: one of its sentences with an identity term, and the same
sentence with the term of another group; where the sentence has none, a term
is put into it, and it is also compared with the sentence as it was. The
squared difference of the two scores is a penalty, whose gradient is followed
as well. Naming a group thus cannot by itself move a score.

Defined results: a null or empty text gets the score of the bias alone;
without any training rows every score is 0.5. Repeated rows are scored each
for itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import ready, whole_text
from quayside.llm.linear import Ftrl, fitted, sigmoid, training_rows

# A power of two.
BUCKETS = 1 << 20
EPOCHS = 4
PENALTY = 2.0
L1_PER_ROW = 0.003
MIN_DOCUMENTS = 6
# Toxic documents are few; missing one costs more than the updates of a harmless one.
POSITIVE_WEIGHT = 4.0

# Terms that name a group neutrally; terms of one line can stand for one another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrant", "refugee", "citizen", "foreigner"),
    ("disabled", "blind", "deaf", "elderly", "young"),
)
_GROUP_OF = {term: group for group in IDENTITY_TERMS for term in group}
_ALL_TERMS = sorted(_GROUP_OF)

_BREAK = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_EDGE = np.uint64(ord("_"))
_STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
GRAMS = (4, 5)


def plain(text: str) -> str:
    """The words of a text in small letters, with one underscore around each."""
    return _BREAK.sub("_", f"_{text.lower()}_")


def grams(spelled: str, buckets: int) -> np.ndarray:
    """Bucket of every character n-gram that lies within a word and its two edges."""
    points = np.frombuffer(spelled.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    edges = np.concatenate([[0], np.cumsum(points == _EDGE)])
    found, hashes = [], points
    shift = np.uint64(64 - (buckets - 1).bit_length())
    with np.errstate(over="ignore"):
        for n in range(2, max(GRAMS) + 1):
            if len(points) < n:
                break
            hashes = hashes[:-1] * _STEP + points[n - 1 :]
            if n in GRAMS:
                # No edge but at the first and last place.
                inside = edges[n - 1 : len(points)] == edges[1 : len(points) - n + 2]
                found.append(((hashes[inside] * _MIX) >> shift).astype(np.int64))
    return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


def features(words: list[str], buckets: int) -> np.ndarray:
    return np.unique(grams("_" + "_".join(words) + "_", buckets))


def swapped(sentence: list[str], draw: np.random.Generator) -> tuple[list[str], list[str]]:
    """A sentence and its counterfactual."""
    named = [i for i, word in enumerate(sentence) if word in _GROUP_OF]
    if named:
        at = int(draw.choice(named))
        others = [term for term in _GROUP_OF[sentence[at]] if term != sentence[at]]
        return sentence, [*sentence[:at], str(draw.choice(others)), *sentence[at + 1 :]]
    at, one = int(draw.integers(len(sentence) + 1)), str(draw.choice(_ALL_TERMS))
    with_one = [*sentence[:at], one, *sentence[at:]]
    if draw.random() < 0.5:
        return sentence, with_one
    other = str(draw.choice([term for term in _GROUP_OF[one] if term != one]))
    return with_one, [*sentence[:at], other, *sentence[at:]]


def fit_weights(
    rows: Iterable[tuple[str, float]], buckets: int = BUCKETS, epochs: int = EPOCHS, penalty: float = PENALTY
) -> np.ndarray:
    examples, rows = [], list(rows)
    # Gradients add up over the rows, and so does what an n-gram must show to get a weight.
    model = Ftrl(buckets, alpha=0.1, beta=1.0, l1=L1_PER_ROW * len(rows), l2=0.1)
    for text, label in rows:
        sentences = [plain(part).strip("_").split("_") for part in _SENTENCE.findall(text)]
        sentences = [s for s in sentences if s != [""]]
        named = [s for s in sentences if any(word in _GROUP_OF for word in s)]
        examples.append((np.unique(grams(plain(text), buckets)), named or sentences, label))
    # What only a few documents hold would be learned by heart.
    found = np.bincount(np.concatenate([e[0] for e in examples] or [np.empty(0, np.int64)]), minlength=buckets) >= MIN_DOCUMENTS
    examples = [(at[found[at]], pool, label) for at, pool, label in examples]
    draw = np.random.default_rng(9)
    for _ in range(epochs):
        for i in draw.permutation(len(examples)):
            at, pool, label = examples[i]
            model.learn(at, np.ones(len(at)), label, POSITIVE_WEIGHT if label else 1.0)
            if not pool:
                continue
            one, other = (features(s, buckets) for s in swapped(pool[int(draw.integers(len(pool)))], draw))
            more, less = np.setdiff1d(one, other, True), np.setdiff1d(other, one, True)
            apart, sign = np.concatenate([more, less]), np.repeat([1.0, -1.0], [len(more), len(less)])
            if len(apart):
                weights = model.weights(apart)
                model.push(apart, weights, 2 * penalty * (weights @ sign) / len(apart) * sign)
    return model.all_weights()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_fold: int = 0,
        id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights by bucket, the bias last; fitted on at most ``linear.MAX_TRAINING_ROWS`` rows."""
    ready(docs.sparkSession)
    return fitted(training_rows(docs, labels, label, folds, held_fold, id_col, text_col), fit_weights)


def logit(text: str, weights: np.ndarray) -> float:
    """Every n-gram counts once, as in training; most have no weight and are left out first."""
    if len(weights) < 2:
        return 0.0
    at = grams(plain(text), len(weights) - 1)
    told = np.unique(at[weights[at] != 0])
    return float(weights[told].sum(dtype=np.float64) + weights[-1])


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col`` and the ``score`` of its whole text, 0 to 1."""
    spark = docs.sparkSession
    ready(spark)
    # Of a fixed size: one number per bucket.
    shared = spark.sparkContext.broadcast(weights.astype(np.float32) if len(weights) else np.zeros(1, np.float32))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = shared.value
        for batch in batches:
            logits = np.array([logit(text, by) for text in batch["text"]], dtype=np.float64)
            yield pd.DataFrame({"id": batch["id"], "score": sigmoid(logits)})

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(scored, f"id {kind}, score double").withColumnRenamed("id", id_col)
