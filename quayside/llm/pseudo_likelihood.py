"""LM scoring by masked pseudo-likelihood: every token is predicted from the tokens on both sides.

Words are mapped to codes: the most frequent words of the corpus have one
each, all others share codes by a hash of their ending. A small network reads
the codes of the words around a place, two on each side, adds what it has
learned of them per position, squashes the sum and predicts the code that
stands there in two steps, its upper and its lower half. A word that shares
its code gets the probability of the code times the word's share in it, by the
counts of all words of the corpus. The sum of the conditional
log-probabilities of all words is the pseudo-log-likelihood of a document.

All words are counted over all documents by Spark. The counts stay a written
table, which grows with the corpus; the words of a document that share codes
are joined to it. Training reads every
document once: in each of ``rounds`` rounds a part of the documents, dealt by
hash, is trained on in parallel, every task from the same parameters, and the
tasks' parameters are averaged by the number of words they have seen. The
parameters have a fixed size, so they are broadcast; the averaging runs in
Spark, per slice of the parameters.

Defined results: a null or empty text has no words, the likelihood 0 and the
perplexity 1. A table without words gives the scores of an untrained model.
A word that was not counted has a share as if it were one more of all the
words that share codes.
Scores depend slightly on how tasks are cut, since averages do.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import ready, whole_text
from quayside.llm.linear import Remembered
from quayside.session import settle

HALF = 32
CODES = HALF * HALF
# Codes with a word of their own; the first code pads texts, the last ones are shared.
OWN = 767
OFFSETS = (-2, -1, 1, 2)
HIDDEN = 16
BATCH = 4_096
RATE = 0.08
SLICES = 64

SHAPES = {
    "around": (len(OFFSETS) * CODES, HIDDEN), "bias": (1, HIDDEN),
    "upper": (HIDDEN, HALF), "upper_bias": (1, HALF), "lower": (HIDDEN, HALF), "lower_bias": (HALF, HALF),
}


def start(seed: int = 1) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    return {name: (draw.standard_normal(shape) * (0.0 if "bias" in name else 0.1)).astype(np.float32) for name, shape in SHAPES.items()}


def packed(parameters: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([parameters[name].ravel() for name in SHAPES])


def unpacked(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = shape[0] * shape[1]
        out[name] = values[at : at + size].reshape(shape).astype(np.float32)
        at += size
    return out


class Coder:
    """Texts in small letters to arrays of codes."""

    def __init__(self, vocabulary: list[str]):
        known = {word.encode(): 1 + i for i, word in enumerate(vocabulary)}
        shared = CODES - 1 - OWN
        self.of_word = Remembered(lambda w: known.get(w) or 1 + OWN + xxhash.xxh32_intdigest(w[-3:]) % shared)

    def of_words(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.of_word.__getitem__, words), dtype=np.int64, count=len(words))

    def __call__(self, text: str) -> np.ndarray:
        return self.of_words(text.encode().split())


def contexts(codes: np.ndarray) -> np.ndarray:
    """Rows of the table ``around`` for every place, one column per offset."""
    width = max(OFFSETS)
    padded = np.concatenate([np.zeros(width, np.int64), codes, np.zeros(width, np.int64)])
    return np.stack([padded[width + o : width + o + len(codes)] + i * CODES for i, o in enumerate(OFFSETS)], axis=1)


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def forward(p: dict[str, np.ndarray], around: np.ndarray, codes: np.ndarray):
    hidden = p["bias"] + p["around"][around[:, 0]]
    for i in range(1, around.shape[1]):
        hidden = hidden + p["around"][around[:, i]]
    hidden = np.tanh(hidden)
    high, low = codes // HALF, codes % HALF
    first = _log_softmax(hidden @ p["upper"] + p["upper_bias"])
    second = _log_softmax(hidden @ p["lower"] + p["lower_bias"][high])
    return hidden, high, low, first, second


def log_probabilities(p: dict[str, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Of every code given its neighbours."""
    out = np.empty(len(codes), dtype=np.float64)
    around = contexts(codes)
    for at in range(0, len(codes), 1 << 15):
        part = slice(at, at + (1 << 15))
        _, high, low, first, second = forward(p, around[part], codes[part])
        every = np.arange(len(high))
        out[part] = first[every, high] + second[every, low]
    return out


class Trainer:
    """Adagrad on batches of places."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = {name: value.copy() for name, value in parameters.items()}
        self.squares = {name: np.full(value.shape, 0.1, dtype=np.float32) for name, value in parameters.items()}

    def _step(self, name: str, gradient: np.ndarray, rows=slice(None)) -> None:
        self.squares[name][rows] += gradient * gradient
        self.p[name][rows] -= RATE * gradient / np.sqrt(self.squares[name][rows])

    def _rows_step(self, name: str, rows: np.ndarray, gradient: np.ndarray) -> None:
        """A step on the rows that occur, with the gradients of equal rows added."""
        order = np.argsort(rows, kind="stable")
        ordered = rows[order]
        begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        self._step(name, np.add.reduceat(gradient[order], begins, axis=0), ordered[begins])

    def learn(self, around: np.ndarray, codes: np.ndarray) -> None:
        p, n = self.p, np.float32(len(codes))
        hidden, high, low, first, second = forward(p, around, codes)
        every = np.arange(len(codes))
        first, second = np.exp(first), np.exp(second)
        first[every, high] -= 1
        second[every, low] -= 1
        first, second = first / n * 64, second / n * 64
        back = (first @ p["upper"].T + second @ p["lower"].T) * (1 - hidden * hidden)
        self._step("upper", hidden.T @ first)
        self._step("upper_bias", first.sum(axis=0, keepdims=True))
        self._step("lower", hidden.T @ second)
        self._rows_step("lower_bias", high, second)
        self._step("bias", back.sum(axis=0, keepdims=True))
        self._rows_step("around", around.ravel(order="F"), np.tile(back, (around.shape[1], 1)))


def small_letters(text_col: str) -> Column:
    """The whole text as it is counted and scored. Spark lowers it in both places, so that no word has two forms."""
    return F.lower(whole_text(text_col))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every word of all documents and how often it occurs, as a written table."""
    words = docs.select(F.explode(F.split(small_letters(text_col), r"[\x20\x09-\x0D]+")).alias("word"))
    return settle(words.filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")


def vocabulary(docs: DataFrame, text_col: str = "text", counts: DataFrame | None = None) -> list[str]:
    """The ``OWN`` most frequent words of all documents, in small letters: those with a code of their own."""
    counted = word_counts(docs, text_col) if counts is None else counts
    return [row["word"] for row in counted.orderBy(F.desc("n"), "word").limit(OWN).collect()]


def log_shares(counts: DataFrame, words: list[str]) -> tuple[DataFrame, float]:
    """Per word that shares its code, the logarithm of its share in the code; and that of a word not counted."""
    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(words)
        for batch in batches:
            yield batch.assign(code=coder.of_words([word.encode() for word in batch["word"]]))

    shared = settle(counts.mapInPandas(coded, "word string, n bigint, code bigint").filter(F.col("code") > OWN), "shared")
    # One row per shared code.
    totals = shared.groupBy("code").agg(F.sum("n").alias("total"))
    everything = shared.agg(F.sum("n")).first()[0] or 0
    shares = shared.join(F.broadcast(totals), "code").select("word", F.log(F.col("n") / F.col("total")).alias("log_share"))
    return shares, -float(np.log(everything + 1))


def train(docs: DataFrame, words: list[str], rounds: int = 2, text_col: str = "text") -> np.ndarray:
    """The packed parameters after one reading of all documents."""
    spark = docs.sparkSession
    ready(spark)
    values = packed(start())
    texts = docs.select(small_letters(text_col).alias("text")).filter("text <> ''")
    for number in range(rounds):
        shared = spark.sparkContext.broadcast(values)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            coder, trainer, seen = Coder(words), Trainer(unpacked(shared.value)), 0
            held, around, size = [], [], 0
            for batch in batches:
                for text in batch["text"]:
                    codes = coder(text)
                    held.append(codes)
                    around.append(contexts(codes))
                    size += len(codes)
                    if size >= BATCH:
                        codes, places = np.concatenate(held), np.concatenate(around)
                        whole = size - size % BATCH
                        for at in range(0, whole, BATCH):
                            trainer.learn(places[at : at + BATCH], codes[at : at + BATCH])
                        held, around, size, seen = [codes[whole:]], [places[whole:]], size - whole, seen + whole
            if size:
                trainer.learn(np.concatenate(around), np.concatenate(held))
            if seen + size:
                slices = np.array_split(packed(trainer.p), SLICES)
                yield pd.DataFrame({"slice": range(SLICES), "values": slices, "seen": seen + size})

        def average(rows: pd.DataFrame) -> pd.DataFrame:
            weights = rows["seen"].to_numpy(dtype=np.float64)
            mean = np.average(np.stack(rows["values"].to_numpy()).astype(np.float64), axis=0, weights=weights)
            return pd.DataFrame({"slice": rows["slice"].iloc[:1], "values": [mean.astype(np.float32)]})

        part = texts.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == number)
        trained = part.mapInPandas(run, "slice int, values array<float>, seen bigint")
        averaged = trained.groupBy("slice").applyInPandas(average, "slice int, values array<float>").orderBy("slice").collect()
        if averaged:
            values = np.concatenate([np.array(row["values"], dtype=np.float32) for row in averaged])
    return values


def score(
    docs: DataFrame, words: list[str], values: np.ndarray, id_col: str = "doc_id", text_col: str = "text", counts: DataFrame | None = None
) -> DataFrame:
    """Per row: id, ``n_tokens``, ``log_likelihood`` of the whole text and ``perplexity`` per word.

    ``counts`` are the :func:`word_counts` of the corpus, without them those of ``docs``.
    """
    spark = docs.sparkSession
    ready(spark)
    shares, not_counted = log_shares(word_counts(docs, text_col) if counts is None else counts, words)
    shared = spark.sparkContext.broadcast(values)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, parameters = Coder(words), unpacked(shared.value)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = text.encode().split()
                codes = coder.of_words(found)
                rare = Counter(found[at] for at in np.flatnonzero(codes > OWN).tolist())
                rows.append((len(codes), log_probabilities(parameters, codes).sum(), [w.decode() for w in rare], list(rare.values())))
            out = pd.DataFrame(rows, columns=["n_tokens", "of_codes", "rare", "times"])
            out.insert(0, "id", batch["id"].array)
            yield out

    rows = docs.select(F.col(id_col).alias("id"), small_letters(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    measured = rows.mapInPandas(run, f"id {kind}, n_tokens bigint, of_codes double, rare array<string>, times array<int>")
    # Ids may be missing or repeated, so rows are numbered; the number is kept by writing it.
    measured = settle(measured.withColumn("row", F.monotonically_increasing_id()), "measured")
    rare = measured.select("row", F.explode(F.arrays_zip("rare", "times")).alias("of")).select("row", F.col("of.rare").alias("word"), F.col("of.times").alias("times"))
    within = rare.join(shares, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.coalesce("log_share", F.lit(not_counted))).alias("of_shares")
    )
    total = F.col("of_codes") + F.coalesce("of_shares", F.lit(0.0))
    return measured.join(within, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", total.alias("log_likelihood"), F.exp(-total / F.greatest("n_tokens", F.lit(1))).alias("perplexity")
    )
