"""Sparse logistic regression by follow-the-regularised-leader updates, and where its rows come from."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import fold, whole_text

# Most labelled rows that a model is fitted on; they are chosen by a hash of their id.
MAX_TRAINING_ROWS = 6_000
# A dictionary of hashes in a Python worker is emptied when it holds so many words.
MAX_REMEMBERED = 400_000


class Remembered(dict):
    """Word to value, computed once per word, with a bound on the memory it takes."""

    def __init__(self, compute: Callable):
        super().__init__()
        self.compute = compute

    def __missing__(self, word):
        if len(self) >= MAX_REMEMBERED:
            self.clear()
        self[word] = value = self.compute(word)
        return value


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


class Ftrl:
    """FTRL-proximal: per-coordinate rates, L1 for sparsity. The last weight is the bias."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 0.05, l1: float = 0.05, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.free = np.array([size])

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def all_weights(self) -> np.ndarray:
        return self.weights(np.arange(len(self.z)))

    def push(self, at: np.ndarray, weights: np.ndarray, gradient: np.ndarray) -> None:
        """Follow a gradient at some coordinates, whose present weights are given."""
        n = self.n[at]
        squared = gradient * gradient
        self.z[at] += gradient - (np.sqrt(n + squared) - np.sqrt(n)) / self.alpha * weights
        self.n[at] = n + squared

    def learn(self, at: np.ndarray, values: np.ndarray, label: float, cost: float = 1.0) -> None:
        at, values = np.append(at, self.free), np.append(values, 1.0)
        weights = self.weights(at)
        self.push(at, weights, cost * (sigmoid(weights @ values) - label) * values)


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_fold: int, id_col: str = "doc_id",
    text_col: str = "text", max_rows: int = MAX_TRAINING_ROWS,
) -> DataFrame:
    """``text`` and ``label`` of at most ``max_rows`` labelled rows outside the held-out fold.

    Rows without an id, a label or a text are not used. The ids are broadcast: they are bounded.
    """
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("label"))
        .filter(F.col("label").isNotNull() & (fold(F.col("_id"), folds) != held_fold)).distinct()
        .orderBy(F.xxhash64(F.col("_id").cast("string")), "_id", "label").limit(max_rows)
    )
    return docs.filter(F.col(text_col).isNotNull()).join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select(
        F.col("_id").alias("order"), whole_text(text_col).alias("text"), "label"
    )


def fitted(rows: DataFrame, fit: Callable[[Iterable[tuple[str, float]]], np.ndarray]) -> np.ndarray:
    """Fit on the bounded ``rows`` in one task and return the weights.

    A table without usable rows gives no weights: an empty array.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "label", "text"], kind="stable")
        weights = fit(list(zip(group["text"], group["label"])))
        used = np.flatnonzero(weights)
        used = used if len(used) and used[-1] == len(weights) - 1 else np.append(used, len(weights) - 1)
        return pd.DataFrame({"at": used, "weight": weights[used]})

    found = rows.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, "at bigint, weight double").toPandas()
    weights = np.zeros(int(found["at"].max()) + 1 if len(found) else 0)
    weights[found["at"]] = found["weight"]
    return weights
