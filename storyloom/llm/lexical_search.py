"""The best documents for each query text by an integer BM25, from a bit-sliced index of impacts.

A block holds up to BLOCK documents in the order of doc_id.  Its index has, for each term, one bitmap
for each bit of the term's impacts on the block's documents.  A query's scores are the sum of its
terms' impacts, taken for all documents of the block at once: bitmaps are added two by two with the
full adder of bitwise logic (sum = a ^ b ^ carry, carry = majority), so the scores come out as bitmaps
again, and the k best are found from their most significant slice down, without sorting a score.

Spark reads the documents twice: once for the numbers of documents, of terms and of documents with a
term, which partial sums add up, and once to build and search the blocks, each in the task that reads
it.  Texts are not shuffled.  A task sends each query's k best once; they meet in two steps, first by
query and a part of the documents, then by query, so no group grows with the corpus.

Queries pass in lots of at most LOT_BYTES of text (a longer one alone), which is what the tasks are
told; more lots mean more readings of the documents, not more memory.

Defined results: a null or empty text has no terms, counts in no statistic and is found by nothing; a
query without terms, or none of whose terms occur, has no rows.  Scores are exact; equal ones are in
the order of doc_id, null last; a repeated row counts and ranks each time.  Texts are whole, of any
length.  Empty tables give an empty result.  Only doc_id (an integer) and text are read of documents,
only item_id and text of queries, whatever other columns there are; a doc_id of 2^63 - 1 counts as null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from storyloom.llm.ragged import LOWER, column, give_back, pieces, row_of, word_spans

#: Documents of a block; a multiple of 64.
BLOCK = 4096
#: Terms of queries that are added up at once.
ROWS = 1536
LOT_BYTES = 4_000_000
#: Parts of the documents whose best meet first.
PARTS = 16
LAST = (1 << 63) - 1

APART = np.ones(256, bool)
APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of these texts one after the other, and the bounds of each text's among them."""
    starts, ends, at = word_spans(data, bounds, APART)
    inside = LOWER[data[~APART[data]]]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(inside)]), at


class Lot:
    """Some queries: their terms numbered, and how often each has each."""

    def __init__(self, queries: list[tuple[object, str]]):
        texts = pa.array([(text or "").encode() for _, text in queries], pa.large_binary())
        words, rows = [], []
        for row, _, data, bounds in pieces(texts):
            got, at = terms(data, bounds)
            words.append(got)
            rows.append(row_of(at) + row)
        coded = pa.chunked_array(words, pa.large_binary()).combine_chunks().dictionary_encode()
        self.items = [item for item, _ in queries]
        self.vocabulary = coded.dictionary
        pair, self.times = np.unique(np.concatenate([np.zeros(0, np.int64), *rows]) * max(len(self.vocabulary), 1) + coded.indices.to_numpy(), return_counts=True)
        self.query, self.term = np.divmod(pair, max(len(self.vocabulary), 1))


def postings(batch: pa.RecordBatch, vocabulary: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, numbers of terms of these rows; row, term and count of what they have of the vocabulary)."""
    for row, _, data, bounds in pieces(column(batch, "text")):
        words, at = terms(data, bounds)
        known = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        has = known >= 0
        pair, count = np.unique(row_of(at)[has] * len(vocabulary) + known[has], return_counts=True)
        yield row, np.diff(at), pair // len(vocabulary), pair % len(vocabulary), count


def statistics(docs: DataFrame, vocabulary: pa.Array) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each term of the vocabulary."""

    def run(batches):
        n, total, df = 0, 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, sizes, _, term, _ in postings(batch, vocabulary):
                n += int(np.count_nonzero(sizes))
                total += int(sizes.sum())
                df += np.bincount(term, minlength=len(vocabulary))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[n, total], df[some]]))], ["term", "n"])
        give_back()

    counts = dict(map(tuple, docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect()))
    return counts.get(-2, 0), counts.get(-1, 0), np.array([counts.get(i, 0) for i in range(len(vocabulary))], np.int64)


def added(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums of numbers given as bit slices (bit, row, word), with one slice more."""
    out = np.empty((len(left) + 1, *left.shape[1:]), np.uint64)
    carry = np.zeros(left.shape[1:], np.uint64)
    for bit, (a, b) in enumerate(zip(left, right)):
        differ = a ^ b
        np.bitwise_xor(differ, carry, out=out[bit])
        carry &= differ
        carry |= a & b
    out[-1] = carry
    return out


def trimmed(slices: np.ndarray) -> np.ndarray:
    """Without the most significant slices that are empty; one stays."""
    used = len(slices)
    while used > 1 and not slices[used - 1].any():
        used -= 1
    return slices[:used]


def summed(slices: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The sum of the rows of each group; groups are numbered from 0 and in order."""
    while len(group) > 1 and (group[1:] == group[:-1]).any():
        first = np.searchsorted(group, group)
        even = (np.arange(len(group)) - first) % 2 == 0
        left = np.flatnonzero(even)
        partner = np.minimum(left + 1, len(group) - 1)
        lonely = even[partner] | (group[partner] != group[left])
        right = slices[:, partner]
        right[:, lonely] = 0
        slices = trimmed(added(slices[:, left], right))
        group = group[left]
    return slices


def best(slices: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, number) of the k largest numbers above 0 of each row, the first places among equal ones."""
    open_ = np.bitwise_or.reduce(slices, axis=0)  # may still be among them
    sure = np.zeros_like(open_)
    for bits in slices[::-1]:
        high = open_ & bits
        fits = np.bitwise_count(sure | high).sum(axis=1, dtype=np.int64) <= k
        sure[fits] |= high[fits]
        open_[fits] &= ~bits[fits]
        open_[~fits] = high[~fits]
    spread = lambda x: np.unpackbits(np.ascontiguousarray(x).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    ties = spread(open_).astype(bool)
    left = k - np.bitwise_count(sure).sum(axis=1, dtype=np.int64)
    ties &= np.cumsum(ties, axis=1) <= left[:, None]
    row, place = np.nonzero(spread(sure).astype(bool) | ties)
    number = np.zeros(len(row), np.int64)
    for bit, bits in enumerate(slices):
        number |= ((bits[row, place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << bit
    return row, place, number


class Block:
    """The bit-sliced index of some documents: postings of (place, term, impact), places in the order of the documents."""

    def __init__(self, place: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int):
        self.words = -(-size // 64)
        self.terms, row = np.unique(term, return_inverse=True)
        key = row * self.words + (place >> 6)
        order = np.argsort(key, kind="stable")
        key, impact, shift = key[order], impact[order].astype(np.uint64), (place[order] & 63).astype(np.uint64)
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        bits = int(impact.max()).bit_length() if len(impact) else 0
        self.slices = np.zeros((max(bits, 1), len(self.terms) * self.words), np.uint64)
        for bit in range(bits):
            self.slices[bit, key[begin]] = np.bitwise_or.reduceat(((impact >> np.uint64(bit)) & np.uint64(1)) << shift, begin)
        self.slices = self.slices.reshape(len(self.slices), len(self.terms), self.words)

    def gathered(self, row: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """The slices of these terms, each times 2 ** shift."""
        bits = len(self.slices)
        out = np.zeros((bits + int(shift.max()), len(row), self.words), np.uint64)
        for s in np.unique(shift).tolist():
            some = np.flatnonzero(shift == s)
            out[s : s + bits, some] = self.slices[:, row[some]]
        return out

    def search(self, lot: Lot, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, place, score) of the k best of each query."""
        if not len(self.terms):
            return
        row = np.minimum(np.searchsorted(self.terms, lot.term), len(self.terms) - 1)
        known = self.terms[row] == lot.term
        query, row, times = lot.query[known], row[known], lot.times[known]
        width = int(times.max()).bit_length() if len(times) else 0
        of, shift = np.nonzero((times[:, None] >> np.arange(width)) & 1)  # a term that is there often counts by powers of two
        query, row = query[of], row[of]
        at = 0
        while at < len(query):
            end = int(np.searchsorted(query, query[min(at + ROWS, len(query) - 1)])) if at + ROWS < len(query) else len(query)
            if end <= at:  # one query has more than ROWS
                end = int(np.searchsorted(query, query[at], "right"))
            total = None
            for a in range(at, end, ROWS):
                b = min(a + ROWS, end)
                names, group = np.unique(query[a:b], return_inverse=True)
                part = summed(self.gathered(row[a:b], shift[a:b]), group)
                if total is not None:
                    bits = max(len(total), len(part))
                    total, part = (np.concatenate([x, np.zeros((bits - len(x), *x.shape[1:]), np.uint64)]) for x in (total, part))
                total = part if total is None else trimmed(added(total, part))
            which, place, score = best(total, k)
            yield names[which], place, score
            at = end


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def first(query: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query."""
    order = np.lexsort([doc, -score, query])
    query = query[order]
    return order[np.arange(len(order)) - np.searchsorted(query, query) < k]


def search_lot(docs: DataFrame, lot: Lot, k: int) -> DataFrame:
    """(query, doc_id, score) of each task's k best documents for each query of the lot."""
    n, total, df = statistics(docs, lot.vocabulary)
    spark = docs.sparkSession
    told = spark.sparkContext.broadcast((lot, weights(n, df)))  # a lot is bounded

    def run(batches):
        lot, weight = told.value
        kept = tuple(np.zeros(0, np.int64) for _ in range(3))
        held, size = [], 0

        def searched(kept):
            ids, place, term, impact = (np.concatenate(x) for x in zip(*held))
            some, place = np.unique(place, return_inverse=True)
            doc = ids[some]
            order = np.argsort(doc, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            block = Block(rank[place], term, impact, len(order))
            got = [kept, *((q, doc[order][p], s) for q, p, s in block.search(lot, k))]
            query, found, score = (np.concatenate(x) for x in zip(*got))
            best_ = first(query, found, score, k)
            return query[best_], found[best_], score[best_]

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, sizes, at, term, count in postings(batch, lot.vocabulary):
                for a in range(0, len(sizes), BLOCK):
                    b = min(a + BLOCK, len(sizes))
                    if size + b - a > BLOCK:
                        kept = searched(kept)
                        held, size = [], 0
                    part = slice(*np.searchsorted(at, [a, b]))
                    m = 75 + (25 * sizes[at[part]] * n) // total
                    impact = weight[term[part]] * ((1_000_000_000 * count[part]) // (1000 * count[part] + 12 * m))
                    real = impact > 0
                    held.append((ids[row + a : row + b], at[part][real] - a + size, term[part][real], impact[real]))
                    size += b - a
        if held:
            kept = searched(kept)
        query, doc, score = kept
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(doc, pa.int64(), mask=doc == LAST), pa.array(score, pa.int64())], ["query", "doc_id", "score"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "query long, doc_id long, score long")


def lots(queries: DataFrame) -> Iterator[Lot]:
    held, size = [], 0
    for item, text in queries.select("item_id", "text").toLocalIterator():
        length = len(text or "")
        if held and size + length > LOT_BYTES // 4:  # a character has four bytes at most
            yield Lot(held)
            held, size = [], 0
        held.append((item, text))
        size += length
    if held:
        yield Lot(held)


def search(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents for each row of queries (item_id, text)."""
    spark, out = docs.sparkSession, None
    kind = queries.schema["item_id"].dataType
    ends = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for turn, lot in enumerate(lots(queries)):
        found = search_lot(docs, lot, k).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
        for keys in (["query", "part"], ["query"]):
            found = found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*ends))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(lot.items)), f"query long, item_id {kind.simpleString()}")
        found = found.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")


#: What search() gives for the table benchmark, as DuckDB SQL.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), s AS (
  SELECT count(*) AS nd, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0
), q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY item_id, term
), tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nd) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, s GROUP BY term
), i AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // total))) AS impact FROM tf JOIN w USING (term), s
), found AS (
  SELECT item_id, r, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM found WHERE score > 0 QUALIFY rank <= 20
"""
