"""Quality rules: how far a document's histograms are from those of any known language.

Two histograms describe a document: its characters by class, and its words by
the common word they are (all others in one class). The same two histograms,
summed over every document of a language, are the references; every language
with ``reference_words`` words has one. The verdict takes the smallest
Jensen-Shannon distance to the reference of any large language or of the
document's own, so a wrong label takes nothing away from a document in a large
language. Where a document's language has no reference, the base rules decide
alone. The references of large languages are few and go to every worker; all
others stay a table that is joined by language. Short documents have noisy
histograms; the allowed distances therefore grow with one over the square
root of the number of words, and below ``min_words`` the base rules decide
alone.

Defined results: a null or empty text has no words and fails the base rules.
A document without any common word is as far away as can be. A table without
documents has no references and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import beside, ready, whole_text
from quayside.session import settle

# The symbols that are counted.
SYMBOLS = "#*$%&|<>"
# Taken off both ends of a word before it is compared with the common ones.
POINTS = ".,;:!?"

# Character classes of the first histogram.
LOWER, UPPER, DIGIT, SPACE, POINT, SYMBOL, OTHER = range(7)
CLASSES = 7


@dataclass(frozen=True)
class Limits:
    """Parameters of the verdict.

    A language gets a reference of up to ``common_words`` words if it holds
    ``reference_words`` words, so that each common one has been seen. It is
    large if it also holds ``min_share`` of all words; there are at most
    ``1 / min_share`` large ones.
    """

    min_words: int = 50
    repeat_percent: int = 50
    common_words: int = 48
    reference_words: int = 2_000
    min_share: float = 0.01
    max_class_distance: float = 0.10
    class_distance_slack: float = 1.2
    max_word_distance: float = 0.15
    word_distance_slack: float = 2.7


def _class_table() -> np.ndarray:
    """Class by code point; what lies beyond the table is looked up one by one."""
    classes = np.full(0x3000, OTHER, dtype=np.int8)
    for point in range(0x3000):
        char = chr(point)
        if char.isspace():
            classes[point] = SPACE
        elif char in SYMBOLS or char in "@=+~^_\\/{}[]`":
            classes[point] = SYMBOL
        elif char.isdigit():
            classes[point] = DIGIT
        elif char.isupper():
            classes[point] = UPPER
        elif char.isalpha():
            classes[point] = LOWER
        elif point < 0x2100 and char.isprintable():
            classes[point] = POINT
    return classes


_CLASS_OF = _class_table()


def class_counts(text: str) -> np.ndarray:
    """Characters by class. Letters without case count as small, as in scripts that have none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    near = points < len(_CLASS_OF)
    counts = np.bincount(_CLASS_OF[points[near]], minlength=CLASSES)
    far = points[~near]
    if len(far):
        for point, times in zip(*np.unique(far, return_counts=True)):
            char = chr(point)
            kind = UPPER if char.isupper() else LOWER if char.isalpha() else DIGIT if char.isdigit() else OTHER
            counts[kind] += times
    return counts


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a window of three words which occurs twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    _, pairs = np.unique(ids[:-1] * np.int64(ids.max() + 1) + ids[1:], return_inverse=True)
    _, windows, times = np.unique(
        pairs[:-1] * np.int64(ids.max() + 1) + ids[2:], return_inverse=True, return_counts=True
    )
    found = times[windows] > 1
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift : shift + n - 2] |= found
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in text.split("\n") if line.encode().strip()]
    return len(lines) - len(set(lines))


def distance(counts: np.ndarray, references: np.ndarray) -> float:
    """The smallest Jensen-Shannon distance (0 to 1) to the rows of ``references``."""
    total = counts.sum()
    if not total or not len(references):
        return 1.0
    p, q = counts / total, references
    middle = (p + q) / 2

    def divergence(of: np.ndarray) -> np.ndarray:
        ratio = np.divide(of, middle, out=np.ones_like(middle), where=(of > 0) & (middle > 0))
        return (of * np.log2(ratio)).sum(axis=1)

    return float(np.sqrt(np.maximum((divergence(np.broadcast_to(p, q.shape)) + divergence(q)) / 2, 0)).min())


def _lang(lang_col: str) -> Column:
    return F.coalesce(F.col(lang_col).cast("string"), F.lit(""))


def reference_table(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Both histograms of every language with enough words, summed over all its documents, as a written table.

    A row has ``lang``, whether it is ``large``, its common ``words`` with their ``shares``, and its ``classes``.
    """
    ready(docs.sparkSession)
    rows = docs.select(_lang(lang_col).alias("lang"), whole_text(text_col).alias("text"))
    words = rows.select("lang", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word"))
    words = words.select("lang", F.btrim(F.lower("word"), F.lit(POINTS)).alias("word")).filter("word <> ''")
    counted = settle(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    totals = settle(counted.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    everything = totals.agg(F.sum("total")).first()[0] or 0
    stable = totals.filter(F.col("total") >= limits.reference_words)
    # A common word is one of the most frequent; anything under a 2,000th of its language is none.
    # So a language has at most 2,000 of them, and one without any has all its words in the last class.
    common = (
        counted.join(stable, "lang").filter(F.col("n") * 2_000 >= F.col("total"))
        .groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "word")), False), 1, limits.common_words).alias("top"))
    )

    def counted_classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = pd.DataFrame([class_counts(text) for text in batch["text"]], columns=names, dtype="int64")
            yield counts.groupby(batch["lang"].to_numpy()).sum().rename_axis("lang").reset_index()

    names = [f"c{i}" for i in range(CLASSES)]
    characters = rows.mapInPandas(counted_classes, f"lang string, {' bigint, '.join(names)} bigint").groupBy("lang").agg(
        *[F.sum(name).alias(name) for name in names]
    )
    top = F.coalesce("top", F.array().cast("array<struct<n:bigint,word:string>>"))
    return settle(stable.join(characters, "lang").join(common, "lang", "left").select(
        "lang", (F.col("total") >= everything * limits.min_share).alias("large"),
        F.transform(top, lambda entry: entry["word"]).alias("words"),
        F.transform(top, lambda entry: entry["n"] / F.col("total")).alias("shares"), F.array(*names).alias("classes"),
    ), "references")


def language_references(
    docs: DataFrame, limits: Limits = Limits(), text_col: str = "text", lang_col: str = "lang", table: DataFrame | None = None
) -> list[dict]:
    """The references of the large languages, from :func:`reference_table`; what comes to the driver is bounded."""
    table = reference_table(docs, limits, text_col, lang_col) if table is None else table
    return [
        {"lang": row["lang"], "words": dict(zip(row["words"], row["shares"])), "classes": row["classes"]}
        for row in table.filter("large").orderBy("lang").collect()
    ]


OWN = ("_words", "_shares", "_classes")


def by_language(docs: DataFrame, references: list[dict], others: DataFrame | None, lang_col: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows of the languages in ``references``, and all others with :data:`OWN`, null where they have no reference.

    Only the second are joined, so that no large language meets in one task.
    """
    if lang_col not in docs.columns:
        return docs, None
    known = _lang(lang_col).isin([ref["lang"] for ref in references])
    rest = docs.filter(~known)
    if others is None:
        return docs.filter(known), rest.withColumns({"_words": F.lit(None).cast("array<string>"), "_shares": F.lit(None).cast("array<double>"), "_classes": F.lit(None).cast("array<bigint>")})
    own = others.select(F.col("lang").alias("_lang"), *[F.col(name[1:]).alias(name) for name in OWN])
    return docs.filter(known), rest.join(own, _lang(lang_col) == F.col("_lang"), "left").drop("_lang")


class Judge:
    """Measures texts against references; one per Python worker and batch stream."""

    def __init__(self, references: list[dict], limits: Limits):
        self.limits = limits
        vocabulary = sorted({word for ref in references for word in ref["words"]})
        self.place = {word: i for i, word in enumerate(vocabulary)}
        self.size = len(vocabulary) + 1
        self.words = np.zeros((len(references), self.size))
        self.classes = np.zeros((len(references), CLASSES))
        for i, ref in enumerate(references):
            for word, share in ref["words"].items():
                self.words[i, self.place[word]] = share
            self.words[i, -1] = max(0.0, 1 - sum(ref["words"].values()))
            total = sum(ref["classes"]) or 1
            self.classes[i] = np.array(ref["classes"]) / total

    def distances(self, words: list[tuple[str, int]], classes: np.ndarray) -> tuple[float, float]:
        histogram = np.zeros(self.size)
        for word, count in words:
            histogram[self.place.get(word, -1)] += count
        return distance(classes, self.classes), distance(histogram, self.words)

    def measure(self, text: str, own: Judge | None = None, alone: bool = False) -> tuple:
        """``own`` knows one more reference; ``alone`` if the base rules decide alone."""
        limits = self.limits
        words = text.encode().split()
        n = len(words)
        ids: dict[bytes, int] = {}
        numbered = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
        symbols = sum(text.count(symbol) for symbol in SYMBOLS)
        repeats = repeated_words(numbered)
        failed = n < limits.min_words or 100 * repeats > limits.repeat_percent * n
        found, characters = [], 0
        for word, count in zip(ids, np.bincount(numbered, minlength=len(ids)).tolist()):
            word = word.decode()
            characters += len(word) * count
            found.append((word.lower().strip(POINTS), count))
        classes = class_counts(text).astype(float)
        by_class, by_word = self.distances(found, classes)
        if own is not None:
            by_class, by_word = map(min, (by_class, by_word), own.distances(found, classes))
        noise = 1 / np.sqrt(max(n, 1))
        kept = not failed and (alone or (
            by_class <= limits.max_class_distance + limits.class_distance_slack * noise
            and by_word <= limits.max_word_distance + limits.word_distance_slack * noise
        ))
        return n, characters, symbols, repeated_lines(text), repeats, failed, by_class, by_word, kept

    def measure_with(self, text: str, words, shares, classes) -> tuple:
        """The measures of a text in a language with the given reference, or with none."""
        if words is None:
            return self.measure(text, alone=True)
        own = {"words": dict(zip(words, shares)), "classes": list(classes)}
        return self.measure(text, own=Judge([own], self.limits))


MEASURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, class_distance double, word_distance double, kept boolean"
)
NAMES = [part.split()[0] for part in MEASURES.split(", ")]


def judge(
    docs: DataFrame, references: list[dict], limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", others: DataFrame | None = None,
) -> DataFrame:
    """Per row: ``id_col`` and the measures of its whole text, with the verdict ``kept``.

    ``others`` are the rows of the reference table that are not in ``references``.
    """
    ready(docs.sparkSession)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = Judge(references, limits)
        for batch in batches:
            if OWN[0] in batch:
                rows = [by.measure_with(*row) for row in zip(batch["text"], *[batch[name] for name in OWN])]
            else:
                rows = [by.measure(text) for text in batch["text"]]
            out = pd.DataFrame(rows, columns=NAMES)
            out.insert(0, "id", batch["id"].array)
            yield out

    def of(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"), *[c for c in OWN if c in rows.columns])
        kind = rows.schema["id"].dataType.simpleString()
        return rows.mapInPandas(measured, f"id {kind}, {MEASURES}").withColumnRenamed("id", id_col)

    known, rest = by_language(docs, references, others, lang_col)
    return of(known) if rest is None else of(known).unionByName(of(rest))


def keep_good(
    docs: DataFrame, references: list[dict], limits: Limits = Limits(), text_col: str = "text", lang_col: str = "lang", others: DataFrame | None = None
) -> DataFrame:
    """The rows that the verdict keeps, with all their columns, which may have any names."""
    return beside(docs, [text_col, lang_col], lambda rows: _good(rows, references, limits, text_col, lang_col, others))


def _good(docs: DataFrame, references: list[dict], limits: Limits, text_col: str, lang_col: str, others: DataFrame | None) -> DataFrame:
    ready(docs.sparkSession)

    @F.pandas_udf("boolean")
    def is_kept(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        by = Judge(references, limits)
        for texts in batches:
            yield pd.Series([bool(by.measure(text)[-1]) for text in texts])

    @F.pandas_udf("boolean")
    def is_kept_with(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        by = Judge(references, limits)
        for columns in batches:
            yield pd.Series([bool(by.measure_with(*row)[-1]) for row in zip(*columns)])

    known, rest = by_language(docs, references, others, lang_col)
    good = known.filter(is_kept(whole_text(text_col)))
    return good if rest is None else good.unionByName(rest.filter(is_kept_with(whole_text(text_col), *OWN)).select(*docs.columns))
