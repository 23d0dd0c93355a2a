"""Whole texts on their way through a shuffle: keys, buckets, compressed blobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from storyloom.llm.ragged import column, mix

#: A null doc_id, in order after all others.
LAST = (1 << 63) - 1


def parts(records: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(key, kind="stable")
    records, key = records[order], key[order]
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
    for a, b in zip(edges, [*edges[1:], len(key)]):
        yield int(key[a]), records[a:b].tobytes()


def doc_bucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(docs.astype(np.uint64) + np.uint64(12345)) % np.uint64(buckets)).astype(np.int64)


def document_keys(batch: pa.RecordBatch, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """doc_id with null as LAST, and 32 bits of the text's hash."""
    docs = batch.column(batch.schema.get_field_index("doc_id")).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
    return docs, np.fromiter((xxhash.xxh3_64_intdigest(text.as_buffer()) & 0xFFFFFFFF for text in texts), np.uint32, len(texts))


def packed(docs: DataFrame, buckets: int) -> DataFrame:
    """Texts by bucket of their document, compressed a batch at a time."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = column(batch, "text")
            ids, hashes = document_keys(batch, texts)
            bucket = doc_bucket(ids, buckets)
            for b in np.unique(bucket).tolist():
                rows = np.flatnonzero(bucket == b)
                some = texts.take(pa.array(rows))
                raw = [x.as_buffer().to_pybytes() for x in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b], pa.int32()),
                        pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), batch.column(0).take(pa.array(rows)).cast(pa.int64())),
                        pa.array([hashes[rows].astype("<u4").tobytes()], pa.binary()),
                        pa.array([np.array([len(r) for r in raw], "<i8").tobytes()], pa.binary()),
                        pa.array([squeeze.compress(b"".join(raw))], pa.binary()),
                    ],
                    ["bucket", "docs", "th", "lengths", "blob"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, docs array<long>, th binary, lengths binary, blob binary")


def unpacked(table: pa.Table) -> Iterator[tuple[int | None, int, int, memoryview]]:
    """doc_id, key of the document, text's hash, text."""
    for i in range(table.num_rows):
        raw = memoryview(zstandard.ZstdDecompressor().decompress(table.column("blob")[i].as_py()))
        at = 0
        lengths = np.frombuffer(table.column("lengths")[i].as_py(), "<i8").tolist()
        for doc, th, n in zip(table.column("docs")[i].as_py(), np.frombuffer(table.column("th")[i].as_py(), "<u4").tolist(), lengths):
            yield doc, LAST if doc is None else doc, th, raw[at : at + n]
            at += n
