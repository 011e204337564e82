import random
import re
from collections import Counter, defaultdict

from quayside.llm import collocations

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n string, level string"


def mined(rows, top=2000, least=10, percent=50):
    """Everything counted, as the contract says."""
    total, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in candidates.items():
            if len(p) == 3:
                covered |= {part for part in (p[:2], p[1:]) if 100 * a >= percent * counts[part]}
        rows_of = []
        for p, a in candidates.items():
            if p not in covered:
                cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows_of.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_of)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def got(spark, rows, **options):
    docs = spark.createDataFrame([(i, text, lang, "x", "y", "z") for i, (text, lang) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in collocations.mine(docs, **options).collect())


def test_random_texts(spark):
    dice = random.Random(5)
    vocabulary = ["The", "the", "é", "É", "x1", "longer", " ", "wörd", "a", "B\x1c"]
    rows = [(None, "en"), ("", None), ("...", "fr"), ("one", None), ("a b " * 2000, "de"), ("no\x00thing twice", "zz")]
    for _ in range(300):
        joint = [dice.choice([" ", " ", " ", " \t ", ". ", ",", "\n", "\r\n", "\x0b", " ; "]) for _ in range(40)]
        text = "".join(dice.choice(vocabulary[: 4 + dice.randrange(7)]) + j for j in joint)
        rows.append((text, dice.choice(["en", "en", "en", "fr", None, "und"])))
    for options in ({}, {"top": 3}, {"top": 7, "least": 2, "percent": 80}):
        assert got(spark, rows, **options) == mined(rows, **options)


def test_covered_pairs_make_the_frontier_fall(spark):
    """The best pairs are made up for by triples that score low, so the first frontiers do not settle the language."""
    rows = [(f"left{i} right{i} the", "en") for i in range(60) for _ in range(12)]
    rows += [(f"p{i} q{i % 5}. p{i} q{i % 7}", "en") for i in range(40) for _ in range(11)]
    rows += [("tie one. tie two. tie three", "fr")] * 12
    seen = []
    count = collocations.count_phrases

    def counted(docs, size, *args, **kwargs):
        seen.append(size)
        return count(docs, size, *args, **kwargs)

    collocations.count_phrases = counted
    try:
        assert got(spark, rows, top=2) == mined(rows, top=2)
    finally:
        collocations.count_phrases = count
    assert seen.count(3) > 1


def test_no_documents(spark):
    assert got(spark, []) == []


def test_products_above_64_bits(spark):
    """Counts of 10^13 score exactly."""
    a, left, right = 9_999_999_999_999, 10_000_000_000_001, 9_999_999_999_999
    row = spark.createDataFrame([(a, left, right)], "n bigint, l bigint, r bigint").select(collocations._score("n", "l", "r")).first()
    assert row[0] == 1_000_000 * a * a // (left * right)


def test_a_filter_never_loses_a_phrase(spark):
    phrases = [("en", f"p{i} q{i * 7}") for i in range(3000)]
    held = collocations.phrase_filter(spark.createDataFrame(phrases, "lang string, phrase string"))
    assert held.may_hold(collocations._hashes("en", [p.encode() for _, p in phrases])).all()
    assert held.may_hold(collocations._hashes("fr", [p.encode() for _, p in phrases])).mean() < 0.05
