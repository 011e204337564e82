"""Phrases of two and three words that belong together, found by growing them from their prefixes.

A phrase scores by how often its parts are met outside of it: cut after its
first k words, f(phrase)^2 / (f(first part) * f(rest)), and the lowest cut
counts. The count of a prefix bounds every phrase that grows from it:

* a phrase occurs no more often than its prefix, so words and pairs below the
  least count have no candidates behind them;
* a triple w1 w2 w3 scores at most f(w1 w2) / f(w1), because cut after w1 its
  rest is met at least as often as it is.

So pairs are grown best first. Per language the frontier starts at the score
that enough pairs reach, all pairs with a bound of at least that are grown, and
the frontier falls until as many surviving phrases reach it as are wanted.
Nothing that is left unopened can reach the last of them, so the result, ties
included, is that of counting everything.

Counting runs in Python on whole batches and is combined before the shuffle;
joins, bounds and frontiers are DataFrames. Which n-grams are worth counting is
told by Bloom filters of bounded size, which can only let too many through; the
rest is taken out by exact joins.

Defined results: a null text is empty, a null language is ``und``, a text
without words counts for nothing. Repeated rows count each. A language with
fewer surviving phrases than wanted returns all of them. Equal scores are
ordered by count, then by the phrase in byte order. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import ready, whole_text
from quayside.session import settle

# Contract values.
TOP = 2_000
LEAST_COUNT = 10
COVER_PERCENT = 50
SCALE = 1_000_000
# The first frontier holds so many times the wanted phrases, each further one so many times the one before.
FRONTIER_GROWTH = 4
# A Bloom filter has 16 bits for each of its keys, and never more than 2^28 bits (32 MB).
FILTER_BITS_PER_KEY = 16
LARGEST_FILTER = 28
# Texts are counted in batches of so many bytes.
COUNTED_BYTES = 8 << 20
# What ends a piece, and what separates words inside one.
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\n" * 10)

_COUNTS = "lang string, phrase string, n bigint"
_COUNTS_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


# ------------------------------------------------------------------ counting


def _hash(lang: str, phrase: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + phrase)


class Filter:
    """Which phrases a set may hold: never wrong about what it does hold."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, dtype=np.uint8)
        self.mask = np.uint64(len(bits) * 8 - 1)

    @staticmethod
    def positions(hashes: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        return hashes & mask, (hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) & mask

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        held = np.ones(len(hashes), dtype=bool)
        for places in self.positions(hashes, self.mask):
            held &= (self.bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return held


def phrase_filter(phrases: DataFrame) -> Filter:
    """A filter of the (lang, phrase) rows. Segments of its bits are set in Spark; at most 32 MB come to the driver."""
    ready(phrases.sparkSession)
    size = min(max(10, (phrases.count() * FILTER_BITS_PER_KEY - 1).bit_length()), LARGEST_FILTER)
    segment = 1 << min(size, 16)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = np.fromiter((_hash(lang, p.encode()) for lang, p in zip(batch["lang"], batch["phrase"])), np.uint64, len(batch))
            found = np.unique(np.concatenate(Filter.positions(hashes, np.uint64((1 << size) - 1)))).astype(np.int64)
            yield pd.DataFrame({"segment": found // segment, "place": found % segment})

    def bits(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # A segment has at most 65,536 places, whatever the number of phrases.
        flags = np.zeros(max(segment, 8), dtype=np.uint8)
        flags[rows["place"].to_numpy()] = 1
        return pd.DataFrame({"segment": [key[0]], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    set_places = phrases.select("lang", "phrase").mapInPandas(places, "segment bigint, place bigint").distinct()
    whole = bytearray(1 << (size - 3))
    width = segment // 8
    for row in set_places.groupBy("segment").applyInPandas(bits, "segment bigint, bits binary").toLocalIterator():
        whole[row.segment * width : row.segment * width + width] = row.bits[:width]
    return Filter(bytes(whole))


def _words(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words of a batch as numbers, -1 between pieces and texts, and the words that the numbers stand for.

    Splitting bytes knows ASCII white space only; all of it but space and tab ends a piece.
    """
    numbers: dict[bytes, int] = {}
    found: list[int] = []
    for text in texts:
        for piece in text.lower().translate(_ENDS).split(b"\n"):
            found.extend([numbers.setdefault(word, len(numbers)) for word in piece.split()])
            found.append(-1)
    return np.array(found, dtype=np.int64), list(numbers)


def _hashes(lang: str, phrases: list[bytes]) -> np.ndarray:
    return np.fromiter((_hash(lang, phrase) for phrase in phrases), np.uint64, len(phrases))


def _joined(words: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    """The phrases of word numbers, joined by spaces."""
    parts = [words.take(pa.array(column)) for column in columns]
    return parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, b" ")


def _different(columns: list[np.ndarray], n_words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of word numbers, and how often each is met."""
    if n_words ** len(columns) >= 1 << 63:
        rows, counts = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
        return list(rows.T), counts
    key = columns[0]
    for column in columns[1:]:
        key = key * n_words + column
    key, counts = np.unique(key, return_counts=True)
    found = []
    for _ in columns:
        found.append(key % n_words)
        key = key // n_words
    return found[::-1], counts


class Counter:
    """Counts the phrases of one size in batches of texts."""

    def __init__(self, size: int, words: Filter | None = None, prefixes: Filter | None = None, rests: Filter | None = None):
        self.size, self.words, self.prefixes, self.rests = size, words, prefixes, rests

    def _grown(self, lang: str, found: np.ndarray, words: pa.Array, inside: np.ndarray) -> np.ndarray:
        """Where a triple starts that one of the two filters asks for."""
        at = np.flatnonzero(inside)
        pairs, which = np.unique(found[at] * len(words) + found[at + 1], return_inverse=True)
        hashes = _hashes(lang, _joined(words, [pairs // len(words), pairs % len(words)]).to_pylist())
        grows, may_be_held = np.zeros(len(found), dtype=bool), np.zeros(len(found), dtype=bool)
        grows[at] = self.prefixes.may_hold(hashes)[which]
        may_be_held[at] = self.rests.may_hold(hashes)[which]
        return inside[:-1] & inside[1:] & (grows[: len(inside) - 1] | may_be_held[1 : len(inside)])

    def __call__(self, lang: str, texts: list[bytes]) -> pa.RecordBatch | None:
        found, known = _words(texts)
        if not known:
            return None
        words = pa.array(known, pa.binary())
        if self.words is not None:
            # The last place stands for the ends of pieces, which have number -1.
            useful = np.append(self.words.may_hold(_hashes(lang, known)), False)
            found = np.where(useful[found], found, -1)
        runs = [found[i : len(found) - self.size + 1 + i] for i in range(self.size)]
        wanted = np.logical_and.reduce([run >= 0 for run in runs])
        if self.prefixes is not None:
            pairs_inside = (found[:-1] >= 0) & (found[1:] >= 0)
            wanted = self._grown(lang, found, words, pairs_inside)
        if not wanted.any():
            return None
        columns, counts = _different([run[wanted] for run in runs], len(known))
        phrases = _joined(words, columns)
        langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(counts), dtype=np.int64)))
        # Not checked to be text: it is made of bytes that came as text.
        return pa.RecordBatch.from_arrays([langs, phrases.view(pa.string()), pa.array(counts, pa.int64())], schema=_COUNTS_ARROW)


def count_phrases(docs: DataFrame, size: int, words: Filter | None = None, prefixes: Filter | None = None,
                  rests: Filter | None = None) -> DataFrame:
    """(lang, phrase, n): how often every phrase of ``size`` words occurs.

    ``docs`` is (lang, text). With ``words`` only phrases all of whose words the
    filter may hold are counted. With ``prefixes`` and ``rests`` only triples
    whose first pair the one or whose last pair the other may hold. A phrase is
    counted at all its places or nowhere.
    """
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(Counter(size, words, prefixes, rests))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = sent.value
        held: dict[str, list[bytes]] = {}
        gathered = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                if (out := count(lang, texts)) is not None:
                    yield out
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                held.setdefault(lang, []).append(text)
                gathered += len(text)
                if gathered >= COUNTED_BYTES:
                    yield from counted()
                    gathered = 0
        yield from counted()

    counted = docs.select("lang", "text").mapInArrow(run, _COUNTS)
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------- scoring


def _score(a: str, first: str, rest: str) -> Column:
    # Counts below 10^14: their products, times a million, have at most 35 digits, so nothing is rounded.
    ratio = f"CAST(CAST({a} AS DECIMAL(14,0)) * CAST({a} AS DECIMAL(14,0)) * {SCALE} AS DECIMAL(38,0))"
    return F.expr(f"{ratio} div (CAST({first} AS DECIMAL(14,0)) * CAST({rest} AS DECIMAL(14,0)))")


def _part(first: int, last: int) -> Column:
    """Words ``first`` to ``last`` of the phrase, counted from 1."""
    return F.array_join(F.slice(F.split("phrase", " "), first, last - first + 1), " ")


def _with_count(df: DataFrame, counts: DataFrame, part: Column, name: str) -> DataFrame:
    known = counts.select("lang", F.col("phrase").alias("_part"), F.col("n").alias(name))
    return df.withColumn("_part", part).join(known, ["lang", "_part"]).drop("_part")


def scored_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, bound): ``bound`` is what no triple that grows from the pair exceeds."""
    parts = _with_count(_with_count(pairs, words, _part(1, 1), "l"), words, _part(2, 2), "r")
    return parts.select(
        "lang", "phrase", F.col("n").alias("a"), "l", "r", _score("n", "l", "r").alias("score"),
        F.expr(f"CAST(n AS DECIMAL(14,0)) * {SCALE} div CAST(l AS DECIMAL(14,0))").alias("bound"),
    )


def scored_triples(triples: DataFrame, pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) with the parts of the lower cut; of equal ones the earlier."""
    df = triples
    for counts, (begin, end), name in ((words, (1, 1), "l1"), (pairs, (2, 3), "r1"), (pairs, (1, 2), "l2"), (words, (3, 3), "r2")):
        df = _with_count(df, counts, _part(begin, end), name)
    cuts = df.withColumns({"s1": _score("n", "l1", "r1"), "s2": _score("n", "l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    return cuts.select(
        "lang", "phrase", F.col("n").alias("a"), F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"),
    )


def uncovered_pairs(pairs: DataFrame, triples: DataFrame, percent: int = COVER_PERCENT) -> DataFrame:
    """Pairs that no triple around them (lang, phrase, n) makes up for.

    The most frequent triple decides, so every pair meets one row.
    """
    around = triples.select("lang", F.explode(F.array(_part(1, 2), _part(2, 3))).alias("phrase"), "n")
    largest = around.groupBy("lang", "phrase").agg(F.max("n").alias("_around"))
    covered = F.expr(f"CAST(_around AS DECIMAL(20,0)) * 100 >= CAST(a AS DECIMAL(20,0)) * {percent}")
    return pairs.join(largest, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False))).drop("_around")


def _reached_by(phrases: DataFrame, wanted: int) -> DataFrame:
    """(lang, level): the largest score that at least ``wanted`` phrases reach, 0 where there are fewer.

    Scores are whole numbers up to a million, so a language has at most so many levels.
    """
    levels = phrases.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
    from_top = Window.partitionBy("lang").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    reached = levels.withColumn("n", F.sum("n").over(from_top))
    return reached.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("n") >= wanted, F.col("score"))), F.lit(0)).alias("level"))


# ------------------------------------------------------------------- growing


def mine(docs: DataFrame, top: int = TOP, least: int = LEAST_COUNT, percent: int = COVER_PERCENT, lang: str = "lang",
         text: str = "text") -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), whole_text(text).alias("text"))
    words = settle(count_phrases(docs, 1), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = words.filter(F.col("n") >= least)
    useful_words = phrase_filter(frequent)
    # Both words of a pair are as frequent as it is, so the filter loses no candidate.
    pairs = settle(count_phrases(docs, 2, words=useful_words).filter(F.col("n") >= least), "pairs")
    scored = settle(scored_pairs(pairs, frequent), "scored-pairs")

    open_langs = settle(totals.select("lang"), "open-languages")
    finished = None
    wanted = top * 2
    while True:
        levels = settle(_reached_by(scored.join(open_langs, "lang", "left_semi"), wanted), "levels")
        frontier = scored.join(levels, "lang")
        # A pair that may be returned has to be held against the triples around it, also those that do not start with it.
        prefixes = frontier.filter(F.col("bound") >= F.col("level")).select("lang", "phrase")
        rests = frontier.filter(F.col("score") >= F.col("level")).select("lang", "phrase")
        still_open = docs if finished is None else docs.join(open_langs, "lang", "left_semi")
        counted = count_phrases(still_open, 3, useful_words, phrase_filter(prefixes), phrase_filter(rests))
        grown = settle(counted.filter(F.col("n") >= least), "triples")
        triples = scored_triples(grown, pairs, frequent)
        pairs_left = uncovered_pairs(frontier.filter(F.col("score") >= F.col("level")).drop("bound", "level"), grown, percent)
        reached = triples.join(levels, "lang").filter(F.col("score") >= F.col("level")).drop("level")
        surviving = settle(pairs_left.unionByName(reached), "surviving")
        settled = surviving.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= top).select("lang")
        settled = settle(settled.unionByName(levels.filter("level = 0").select("lang")).distinct(), "settled-languages")
        done = surviving.join(settled, "lang", "left_semi")
        finished = done if finished is None else finished.unionByName(done)
        open_langs = settle(open_langs.join(settled, "lang", "left_anti").join(levels, "lang", "left_semi"), "open-languages")
        if open_langs.isEmpty():
            break
        wanted *= FRONTIER_GROWTH

    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = finished.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )
