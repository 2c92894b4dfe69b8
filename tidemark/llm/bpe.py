"""BPE encoding and decoding of whole texts through a table of distinct words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import tokens
from tidemark.llm.common import binary, mapper, texts

ENCODED = "doc_id bigint, text string, n_tokens bigint, ids binary"


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, text, n_tokens, ids)`` of each row; ids are little-endian unsigned 32-bit.

    Each task splits its texts into words, encodes each distinct word once and joins the ids back
    by position. Documents never move: the plan is one scan without a shuffle.

    A null text counts as empty and has no ids; it stays null in ``text``. A null ``doc_id``,
    repeated rows and ties are kept row by row. An empty table gives none. Texts of any length are
    encoded whole. Further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokens.read_vocabulary(vocabulary))

    def rows(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = tokens.load(shared.value)
        ids = [bpe.encode(x) for x in part["text"].to_pylist()]
        n = pa.array([len(x) // 4 for x in ids], type=pa.int64())
        yield pa.RecordBatch.from_arrays(
            [part["doc_id"], part["text"], n, binary(ids)], ["doc_id", "text", "n_tokens", "ids"]
        )

    return texts(docs).mapInArrow(mapper(rows), ENCODED)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)``: ids joined to the pieces of the vocabulary.

    The piece table has as many rows as the vocabulary, so it goes to every task. Bytes that are no
    UTF-8 become U+FFFD. Null ids count as none; an id outside the vocabulary is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(tokens.read_vocabulary(vocabulary))

    def rows(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = tokens.load(shared.value)
        out = [bpe.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in part["ids"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [part["doc_id"], part["n_tokens"], part["ids"], pa.array(out, type=pa.string())],
            ["doc_id", "n_tokens", "ids", "decoded"],
        )

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        mapper(rows, "ids"), "doc_id bigint, n_tokens bigint, ids binary, decoded string"
    )


def sha256(value: str | bytes) -> str:
    return hashlib.sha256(value.encode() if isinstance(value, str) else value).hexdigest()
