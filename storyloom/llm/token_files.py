"""Token ids in files: shards of blocks, in ascending doc_id order.

A block is one row of a Parquet table: the concatenated ids of consecutive documents in the
narrowest unsigned type (little-endian), and where each document ends as an Elias-Fano code
with its select directory.  A block knows its offset in its shard; a reader needs besides only
the sums of the shards, of which there are as many as write tasks.  The table is written and
read by Spark, so it can lie in any store, and offsets can be read without the ids.

Defined results: a null text is an empty one and holds the end id alone; a null doc_id comes
first; rows that share a doc_id follow the hash of their text, repeated rows each other.  A text of
any length is one document of one block.  An empty table gives a table without blocks.  Columns
other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from storyloom.llm import elias_fano
from storyloom.llm.bpe import encoder
from storyloom.llm.common import text_of
from storyloom.llm.ragged import PIECE_BYTES, column, with_ends

END = 0
#: Documents whose boundaries are looked up at once.
AT_ONCE = 256


def blocks(docs: DataFrame, path: str) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    ordered = docs.select("doc_id", "text", F.xxhash64(text_of()).alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        enc = encoder(path)
        width = 2 if enc.vocabulary.size <= 1 << 16 else 4
        shard, number, offset = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for row, end, ids, bounds in enc.batches(column(batch, "text"), PIECE_BYTES):
                ids, bounds = with_ends(ids, bounds, END)
                bits, low, high, directory = elias_fano.encode(bounds[1:])
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([shard], pa.int32()), "block": pa.array([number], pa.int32()), "offset": pa.array([offset], pa.int64()),
                    "n_docs": pa.array([end - row], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()), "width": pa.array([width], pa.int32()),
                    "doc_ids": pa.ListArray.from_arrays(pa.array([0, end - row], pa.int32()), batch.column(0).slice(row, end - row)),
                    "low_bits": pa.array([bits], pa.int32()), "low": pa.array([low], pa.binary()), "high": pa.array([high], pa.binary()), "directory": pa.array([directory], pa.binary()),
                    "ids": pa.array([ids.astype(f"<u{width}").tobytes()], pa.binary()),
                })
                number, offset = number + 1, offset + len(ids)

    return ordered.mapInArrow(run, f"shard int, block int, offset long, n_docs int, n_ids long, width int, doc_ids array<{kind}>, low_bits int, low binary, high binary, directory binary, ids binary")


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    blocks(docs, tokenizer).write.parquet(path)


def _based(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.parquet(path)
    sums = table.groupBy("shard").agg(F.sum("n_ids").alias("sum"))
    before = F.coalesce(F.sum("sum").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # One row for each write task.
    return table.join(F.broadcast(sums.select("shard", before.alias("base"))), "shard")


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens of every document, from the boundaries alone."""
    kind = dict(spark.read.parquet(path).dtypes)["doc_ids"][6:-1]
    return _read(_based(spark, path).drop("ids"), kind, False)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, and the CRC32 of the ids as 32-bit numbers."""
    kind = dict(spark.read.parquet(path).dtypes)["doc_ids"][6:-1]
    return _read(_based(spark, path), kind, True)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """documents() of a few doc_ids: their blocks alone are opened, and in them select() finds the boundaries."""
    table = _based(spark, path)
    hit = F.arrays_overlap("doc_ids", F.array(*map(F.lit, doc_ids)))
    return _read(table.where(hit), dict(table.dtypes)["doc_ids"][6:-1], True, np.array(doc_ids))


def _read(table: DataFrame, kind: str, with_ids: bool, wanted: np.ndarray | None = None) -> DataFrame:
    fields = ["base", "offset", "n_docs", "width", "doc_ids", "low_bits", "low", "high", "directory", *["ids"] * with_ids]

    def run(batches):
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(fields)}
            for k in range(batch.num_rows):
                get = lambda n: at[n][k].as_py()  # noqa: B023, E731
                code = elias_fano.EliasFano(get("n_docs"), get("low_bits"), get("low"), get("high"), get("directory"))
                names, raw = at["doc_ids"][k].values, np.frombuffer(get("ids"), f"<u{get('width')}") if with_ids else None
                where = np.arange(code.n) if wanted is None else np.flatnonzero(np.isin(names.to_numpy(zero_copy_only=False), wanted))
                for first in range(0, len(where), AT_ONCE):
                    some = where[first : first + AT_ONCE]
                    low = int(some[0])
                    bounds = code.select_many(max(low - 1, 0), int(some[-1]) + 1)
                    bounds = bounds if low else np.concatenate([[0], bounds])
                    starts, ends = bounds[some - low], bounds[some - low + 1]
                    columns = [names.take(pa.array(some)), pa.array(starts + get("base") + get("offset")), pa.array(ends - starts)]
                    if with_ids:
                        columns.append(pa.array([zlib.crc32(raw[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64()))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"][: len(columns)])

    return table.select(*fields).mapInArrow(run, f"doc_id {kind}, start long, n_tokens long" + ", ids_crc32 long" * with_ids)
