"""BPE encoding and decoding of whole texts.

Defined results: a null text is an empty one, without ids; a null doc_id stays null.  Rows that
repeat are encoded one by one.  A text of any length is encoded whole, as one piece.  An empty table
gives an empty result; columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from storyloom.llm.bpe import encoder
from storyloom.llm.ragged import PIECE_BYTES, column, expand


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>)."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            names = batch.column(0)
            for row, end, ids, bounds in enc.batches(column(batch, "text"), PIECE_BYTES):
                yield pa.RecordBatch.from_arrays([names.slice(row, end - row), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of (doc_id, ids)."""

    def run(batches):
        vocabulary = encoder(path).vocabulary
        for batch in batches:
            texts = [vocabulary.decode(np.asarray(ids.values)).tobytes().decode("utf-8", "replace") if ids.is_valid else None for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids in decimal and of the text decoded from them."""

    def run(batches):
        enc = encoder(path)
        names = [b"%d," % i for i in range(enc.vocabulary.size)]
        width = np.array([len(n) for n in names], np.int64)
        start = np.cumsum(width) - width
        digits = np.frombuffer(b"".join(names), np.uint8)
        for batch in batches:
            for row, end, ids, bounds in enc.batches(column(batch, "text"), PIECE_BYTES):
                listed = digits[expand(start[ids], width[ids])].data
                place = np.concatenate([[0], np.cumsum(width[ids])])[bounds].tolist()
                decoded = enc.vocabulary.decode(ids)
                ends = np.concatenate([[0], np.cumsum(enc.vocabulary.token_length[ids])])[bounds].tolist()
                n = end - row
                a = [hashlib.sha256(listed[place[i] : max(place[i], place[i + 1] - 1)]).hexdigest() for i in range(n)]
                b = [hashlib.sha256(decoded[ends[i] : ends[i + 1]].tobytes().decode("utf-8", "replace").encode()).hexdigest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(np.diff(bounds)), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
