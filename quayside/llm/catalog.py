"""The registered queries over the operators of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import bpe, collocations, conversation_repair, html_extract, iblt, jaccard_join, mixing, pii, pseudo_likelihood, quality_classifier, quality_rules, toxicity, warc
from quayside.llm.common import fold, table
from quayside.session import shared_dir

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def rank_file() -> tuple[str, str]:
    """Path of the rank file and the pattern that goes with it, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs)).withColumns({
        "base": pii.as_text("base_spans"), "spans": pii.as_text("all_spans"),
    })
    counts = [
        F.size(F.array_compact(F.transform("base_spans", lambda span: F.when(span["kind"] == kind, 1)))).cast("bigint").alias(f"n_{kind}")
        for kind in pii.BASE_KINDS
    ]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.compared(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next",
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_repeated"
    )


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = pseudo_likelihood.word_counts(docs)
    words = pseudo_likelihood.vocabulary(docs, counts=counts)
    return pseudo_likelihood.score(docs, words, pseudo_likelihood.train(docs, words), counts=counts)


def _scored(scores: DataFrame, folds: int, held_fold: int) -> DataFrame:
    return scores.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_fold, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = quality_classifier.fit(docs, labels, "quality", folds=3, held_fold=1)
    return _scored(quality_classifier.score(docs, weights), 3, 1)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = toxicity.fit(docs, labels, "toxic", folds=5, held_fold=0)
    return _scored(toxicity.score(docs, weights), 5, 0)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = rank_file()
    tokens = bpe.encode(table(spark, sf_dir, "documents"), path, pattern, decoded=True)
    return tokens.select(
        "doc_id", "n_tokens", F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    references = quality_rules.reference_table(docs)
    return quality_rules.judge(docs, quality_rules.language_references(docs, table=references), others=references.filter("not large"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.summary(conversation_repair.repair(rows))


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _way(state: str, cost: str, letter: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}}"


def _kept(states: list[str], initial: str) -> list[str]:
    """Keeping or renaming a row after one of the states; out of reach where that is not allowed."""
    price = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END + CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 ELSE 0 END"
    keep = f"{price} + CASE WHEN initial = '{initial}' THEN 0 ELSE 1000000000 END"
    ways = [_way(state, keep, "K") for state in states]
    return ways if initial == "s" else ways + [_way(state, f"{price} + 3", "R") for state in states]


OP11_SQL = f"""WITH RECURSIVE k AS (SELECT *, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
  h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(flatten(list_transform(range(1, length(key) + 1), lambda i: [ord(key[i]), 0, 0, 0, 0, 0, 0, 0])),
    lambda acc, x: xor(xor(acc, x) >> 1, CASE WHEN xor(acc, x) & 1 = 1 THEN 3988292384 ELSE 0 END), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS f FROM k),
  d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE f <> 0),
  o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, left(role, 1) AS initial, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS visible FROM d),
  r AS (SELECT *, CASE WHEN visible = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN right(visible, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM o),
  counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
  ids AS (SELECT DISTINCT conv_id FROM conversations),
  step(conv_id, pos, s0, s1, s2, s3) AS (SELECT conv_id, CAST(0 AS BIGINT), {{'c': CAST(0 AS BIGINT), 'a': ''}}, {{'c': CAST(1000000000 AS BIGINT), 'a': ''}}, {{'c': CAST(3 AS BIGINT), 'a': 'I'}}, {{'c': CAST(6 AS BIGINT), 'a': 'II'}} FROM ids
    UNION ALL SELECT conv_id, pos, n0, n1, m2, {_least('n3', _way('m2', '3', 'I'))} FROM
      (SELECT *, {_least('n2', _way('n0', '3', 'I'), _way('n1', '3', 'I'), _way('n3', '3', 'I'))} AS m2 FROM
        (SELECT conv_id, pos, {_way('s0', '4', 'D')} AS n0, {_least(_way('s1', '4', 'D'), *_kept(['s0'], 's'))} AS n1,
          {_least(_way('s2', '4', 'D'), *_kept(['s0', 's1', 's3'], 'u'))} AS n2, {_least(_way('s3', '4', 'D'), *_kept(['s2'], 'a'))} AS n3
          FROM (SELECT s.conv_id, r.pos, r.initial, r.fault, s0, s1, s2, s3 FROM step s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.pos = s.pos + 1)))),
  best AS (SELECT conv_id, {_least('s0', 's3')} AS b FROM step QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
  letters AS (SELECT conv_id, b.a AS audit, unnest(range(1, length(b.a) + 1)) AS i FROM best),
  placed AS (SELECT conv_id, i, audit[i] AS letter, sum(CASE WHEN audit[i] <> 'I' THEN 1 ELSE 0 END) OVER w AS pos, sum(CASE WHEN audit[i] <> 'D' THEN 1 ELSE 0 END) OVER w AS j
    FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
  turns AS (SELECT p.conv_id, p.i, p.letter, p.j, r.role, r.text, r.initial FROM placed p LEFT JOIN r ON p.letter <> 'I' AND r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.pos = p.pos WHERE p.letter <> 'D'),
  named AS (SELECT *, max(CASE WHEN j = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS shift FROM turns),
  lines AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS repaired FROM named GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  b.b.c AS cost, b.b.a AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
  FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM b.conv_id"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


OP12_SQL = """WITH w AS (SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM
    (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
  g AS (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM
    (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS s(size)) GROUP BY ALL),
  total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE size = 1 GROUP BY lang),
  c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE size > 1 AND f >= 10),
  cut AS (SELECT c.lang, c.phrase, c.size, c.a, k, p.f AS l, q.f AS r, CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(p.f AS HUGEINT) * q.f) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM c) AS c JOIN g AS p ON p.lang = c.lang AND p.size = k AND p.phrase = array_to_string(c.ws[1:k], ' ')
    JOIN g AS q ON q.lang = c.lang AND q.size = c.size - k AND q.phrase = array_to_string(c.ws[k + 1:], ' ')),
  best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase, size ORDER BY score, k) = 1),
  around AS (SELECT lang, array_to_string(part, ' ') AS phrase, max(a) AS a FROM
    (SELECT lang, a, unnest([ws[1:2], ws[2:3]]) AS part FROM c WHERE size = 3) GROUP BY ALL),
  kept AS (SELECT b.* FROM best b LEFT JOIN around o ON b.size = 2 AND o.lang = b.lang AND o.phrase = b.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM
  (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= 2000"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = shared_dir(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    warc.write_archives(warc.with_first_captures(pages), archives, date="2024-01-01T00:00:00Z")
    return warc.resolved(warc.assemble(warc.read_records(spark, archives)), pages.schema["page_id"].dataType.simpleString())


OP13_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
  q AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
  r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id IS NULL OR page_id = first_id THEN NULL ELSE first_id END AS refers_to FROM r"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_fingerprints": op2_fingerprints,
        "op3_html_extraction": op3_html_extraction,
        "op4_pseudo_likelihood": op4_pseudo_likelihood,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_mixing": op8_mixing,
        "op9_toxicity": op9_toxicity,
        "op10_quality_rules": op10_quality_rules,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_collocations": op12_collocations,
        "op13_warc": op13_warc,
    }


def oracles() -> dict[str, str]:
    return {"op11_conversation_repair": OP11_SQL, "op12_collocations": OP12_SQL, "op13_warc": OP13_SQL}
