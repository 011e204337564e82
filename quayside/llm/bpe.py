"""Byte-level BPE: texts to token ids by a file of merge ranks, and ids back to bytes.

The rank file is a parameter and must lie at the same path on every executor;
it is read once per Python worker. Token ids are stored packed, as unsigned
32-bit little-endian integers, which is also how training shards hold them.

Defined results: a null or empty text has no tokens and decodes to no bytes.
Repeated rows are encoded each for itself, and extra columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import ready, whole_text

# Texts are handed to the tokenizer in parts of about so many characters.
PART_CHARS = 50_000


@lru_cache(maxsize=4)
def encoding(rank_path: str, pattern: str):
    """The tokenizer of a local rank file, without special tokens."""
    import tiktoken

    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts_of(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Cut a long text where no match of a GPT-2 style pattern can reach across.

    Such a pattern lets a match hold a space only as its first character or
    within a run of white space. A space that follows an ASCII letter and
    precedes an ASCII letter therefore always begins a match, and the letter
    before it always ends one. Without such a place the text stays whole.
    """
    begin, length = 0, len(text)
    while length - begin > size:
        cut = begin + size
        while cut < length - 1:
            cut = text.find(" ", cut, length - 1)
            if cut < 0:
                break
            before, after = text[cut - 1], text[cut + 1]
            if before.isascii() and before.isalpha() and after.isascii() and after.isalpha():
                break
            cut += 1
        if cut < 0 or cut >= length - 1:
            break
        yield text[begin:cut]
        begin = cut
    yield text[begin:]


def encode_text(text: str, rank_path: str, pattern: str) -> np.ndarray:
    encode = encoding(rank_path, pattern).encode_ordinary
    parts = [np.array(encode(part), dtype="<u4") for part in parts_of(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def encode(
    docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """Per row: ``id_col``, ``n_tokens`` and ``tokens``, the packed ids of the whole text.

    With ``decoded`` also the bytes that the packed ids decode to, made in the same worker.
    """
    ready(docs.sparkSession)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = [encode_text(text, rank_path, pattern) for text in batch["text"]]
            out = {
                "id": batch["id"],
                "n_tokens": np.array([len(t) for t in tokens], dtype="int64"),
                "tokens": [t.tobytes() for t in tokens],
            }
            if decoded:
                out["decoded"] = [decode_bytes(t, rank_path, pattern) for t in out["tokens"]]
            yield pd.DataFrame(out)

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    columns = f"id {kind}, n_tokens bigint, tokens binary" + ", decoded binary" * decoded
    return rows.mapInPandas(encoded, columns).withColumnRenamed("id", id_col)


def decode_bytes(tokens: bytes, rank_path: str, pattern: str) -> bytes:
    return encoding(rank_path, pattern).decode_bytes(np.frombuffer(tokens, dtype="<u4").tolist())


def decode(
    encoded: DataFrame, rank_path: str, pattern: str, tokens_col: str = "tokens", out: str = "decoded"
) -> DataFrame:
    """Add ``out``: the raw bytes that packed ids stand for.

    Bytes, not text: any cut between ids may fall inside a character. A null
    decodes to no bytes.
    """
    ready(encoded.sparkSession)

    @F.pandas_udf("binary")
    def decoded(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: decode_bytes(t or b"", rank_path, pattern))

    return encoded.withColumn(out, decoded(F.col(tokens_col)))
