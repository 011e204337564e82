"""The pipeline stage by stage, each against a plain version on its own input."""

import os
import re
import subprocess
import sys

import brute
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from quayside.llm import bpe, catalog, quality_rules

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = spark.read.parquet(path)
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_all_but_the_last_return_documents(tables):
    for before, after in tables[:-1]:
        assert after.columns == before.columns


def test_rules_reject_what_the_operator_rejects(spark, tables):
    before, after = tables[0]
    kept = {r["doc_id"] for r in quality_rules.judge(before, quality_rules.language_references(before)).collect() if r["kept"]}
    assert set(by_id(after)) == kept and 0 < len(kept) < before.count()


def test_one_document_of_each_group_stays(tables):
    before, after = tables[1]
    groups = brute.components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
    assert set(by_id(after)) == {i for i, (_, smallest) in groups.items() if i == smallest}


def test_personal_data_is_gone(tables):
    before, after = tables[2]
    texts, redacted = by_id(before), by_id(after)
    assert set(texts) == set(redacted)
    for i, r in redacted.items():
        assert r["n_chars"] == len(r["text"])
        if not re.search(r"[0-9@]", texts[i]["text"]):
            assert r["text"] == texts[i]["text"]
        assert not brute.personal_data(r["text"])


def test_mix_repeats_whole_rows(tables):
    before, after = tables[3]
    texts, times = by_id(before), {}
    for r in after.collect():
        assert tuple(r) == tuple(texts[r["doc_id"]])
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 2
    words = {i: len(brute.WORD.findall(r["text"])) for i, r in texts.items()}
    assert sum(words[i] * n for i, n in times.items()) == pytest.approx(1.5 * sum(words.values()), rel=0.1)


def test_tokens_decode_to_the_texts(tables):
    before, after = tables[4]
    want = sorted((r["doc_id"], r["text"]) for r in before.collect())
    got = sorted((r["doc_id"], bpe.decode_bytes(bytes(r["tokens"]), *catalog.rank_file()).decode()) for r in after.collect())
    assert got == want


def test_hard_rows_pass_every_stage(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "x " * 70, "en", None, 5), (4, "w" * 100_000, "xx", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for one in (docs, docs.filter("false")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, one, SF_DIR).collect()


def test_extra_columns_may_have_private_names(spark):
    """Columns named like those that the stages add for themselves come out as they went in."""
    names = ["_text", "_base", "_all", "_proposed", "_passing", "_id", "_source", "_copies", "_copy", "_words", "_shares",
             "_classes", "_lang", "id", "class", "component_id", "beside_1", "with.dot", "kept"]
    plain = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter("doc_id < 60")
    odd = plain
    for i, name in enumerate(names):
        odd = odd.withColumn(name, F.concat(F.lit(f"{i}-"), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want, got = stage(spark, plain, SF_DIR), stage(spark, odd, SF_DIR)
        assert got.columns == odd.columns, name
        rows = got.collect()
        assert all(r[n] == f"{i}-{r['doc_id']}" for r in rows for i, n in enumerate(names)), name
        assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in want.collect()), name


def test_entry_works_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    told = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(sum(n.startswith('op') or n == 'pipeline' for n in e.queries()), len(e.queries()) > 50)"],
        cwd=copy, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(copy)},
    )
    assert told.stdout.split() == ["0", "True"], told.stderr
