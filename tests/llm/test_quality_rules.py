import brute
import numpy as np

from quayside.llm import catalog, quality_rules

SF_DIR = "/root/testdata/sf0.01"
BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
HARD = [
    None, "", " \t\n", "a b c a b c", "a a a a", "x\n\nx\n x\nx", "#*$%&|<> ##", "é ü  ", "w" * 50_000,
    "one two three " * 5_000, "A\x1cB \x85", "\U0001f600 " * 60, "a b c d a b c e a b c",
]


def test_query_base_matches_brute_force_and_keeps_clean_texts(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    got = catalog.op10_quality_rules(spark, SF_DIR).collect()
    assert sorted(tuple(r[c] for c in BASE) for r in got) == sorted(brute.quality_base(i, t) for i, t in docs.items())
    passed = [r for r in got if not r["base_failed"] and r["doc_id"] in quality]
    good, bad = ([r["kept"] for r in passed if quality[r["doc_id"]] == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_hard_texts(spark):
    docs = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(HARD)], "doc_id bigint, text string, lang string, kept string")
    got = quality_rules.judge(docs, quality_rules.language_references(docs)).collect()
    assert sorted(tuple(r[c] for c in BASE) for r in got) == sorted(brute.quality_base(i, t) for i, t in enumerate(HARD))
    good = quality_rules.keep_good(docs, [])
    assert good.columns == docs.columns and good.count() == 0
    assert quality_rules.language_references(docs.filter("false")) == []


def test_distance():
    one = np.array([[0.5, 0.5, 0.0]])
    assert quality_rules.distance(np.array([2.0, 2.0, 0.0]), one) == 0.0
    assert quality_rules.distance(np.array([0.0, 0.0, 3.0]), one) == 1.0
    assert quality_rules.distance(np.zeros(3), one) == 1.0


def test_small_languages_are_judged_by_their_own_or_by_the_base_rules(spark):
    draw = np.random.default_rng(1)

    def text(letter, n):
        # The k-th word has a share of one over k.
        return " ".join(f"{letter}{'abcdefgh'[k % 8]}{'abcdefgh'[k // 8 % 8]}{k // 64 * 'z'}" for k in np.exp(draw.random(n) * 6).astype(int))

    docs = [(i, text("l", 2_000), "large") for i in range(1_500)]
    docs += [(10_000 + i, text("s", 500), "small") for i in range(6)] + [(20_000, text("r", 200), "rare")]
    docs += [(30_000, " ".join(f"{i}#9{i}" for i in range(300)), "small"), (30_001, text("l", 500), "small")]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").repartition(8)
    table = quality_rules.reference_table(docs)
    # A thousandth of the words is enough for a reference, a few hundred words are not.
    assert {r["lang"]: r["large"] for r in table.collect()} == {"large": True, "small": False}
    references, others = quality_rules.language_references(docs, table=table), table.filter("not large")
    some = docs.filter("doc_id >= 10000")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(some, references, others=others).collect()}
    assert kept == {**{10_000 + i: True for i in range(6)}, 20_000: True, 30_000: False, 30_001: True}
    good = quality_rules.keep_good(some, references, others=others)
    assert {r["doc_id"] for r in good.collect()} == {i for i, k in kept.items() if k} and good.columns == docs.columns
