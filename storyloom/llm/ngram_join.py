"""Groups of documents whose sets of word 5-grams have a Jaccard similarity of at least 0.8.

A document's set are the 64-bit hashes of its distinct shingles.  Sets with equal keys of 128 bits are
one class; one document of it stands for all.

1. Blocks.  Let two sets of n <= m shingles be similar; then they differ in at most (n + m) / 9.
   The hash space is cut into more parts than that, so that some part holds the same shingles
   in both.  A set's signatures are hashes of the contents of its parts; of those that are not
   empty, the (allowed difference + 1) smallest suffice, as for any prefix filter.  The number
   of parts follows the size class of the smaller set; a set signs for its own class and, if
   a smaller partner can lie in the class below, for that one.  Sets that share a signature
   are chained, within a task before anything is shuffled, so that a signature reaches the
   shuffle once from so many, however many sets have it.  Connected chains are blocks: similar
   sets are always in one block.
2. Prefix filter.  Sets that are in a block with another have their n-grams counted, among all
   such sets.  In order of rarity, similar sets share one of their first n-grams; sets that
   share one and are close in size are chained as before.  Shared passages, which made blocks
   large, are common and come last, so that what is left is near copies.
3. Prefix-tree join within what the filter leaves together, in tasks of bounded size.  The sets
   are stored in a radix tree, common n-grams first, so that near copies share their paths.  A set's query walks down the tree, sharing
   the overlap counted so far, and leaves a subtree when even its remaining length cannot
   reach the overlap that the threshold asks for.  Found sets leave the tree and are queried
   next, so a group costs one walk for each set rather than one for each pair.
4. A block with more n-grams than a task takes is joined shard by shard.  One set of each group
   found is then joined across shards; last, what is not in a block's largest group meets
   every shard, so that no link between groups is lost.

Groups of everything are the connected components of the links found.

Defined results: a null or empty text has no shingles and no links, and is its own component;
one to four words are one shingle.  Rows with equal doc_id and text are one document.  A null
doc_id comes after all others.  A text of any length gives one set of all its shingles.  An empty
table gives an empty result.  Columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from storyloom.llm.common import checkpoint, written
from storyloom.llm.ragged import LOWER, PIECE_BYTES, column, expand, give_back, mix, pieces, row_of, word_hashes, word_spans
from storyloom.llm.texts import LAST, doc_bucket, document_keys, packed, parts, unpacked
from storyloom.operators.graph import components

SHINGLE = 5
LEAST, OF = 80, 100
RATIO = 1.25
BUCKET_BYTES = 10_000_000
#: Signatures that a task chains before it sends them.
HELD = 400_000
#: N-grams that one task joins at once.
SHARD = 1_500_000
#: N-grams that every task is told the counts of, at most; rarer ones than OFTEN are none of them.
FREQUENT = 100_000
OFTEN = 10_000
SIGNS, DOCS, EDGES = 0, 1, 2
DOC = np.dtype([("doc", "<i8"), ("th", "<u4"), ("n", "<u4"), ("k", "<i8"), ("k2", "<i8")])
SCHEMA = "kind int, bucket int, blob binary"
_STEPS = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(SHINGLE)]


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of each row, ascending in the row; bounds)."""
    data = LOWER[data]
    starts, ends, words = word_spans(data, bounds)
    count = np.diff(words)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    hashes = word_hashes(data, starts, ends)
    whole = np.maximum(count - SHINGLE + 1, 0)
    at = expand(words[:-1], whole)
    long = np.zeros(len(at), np.uint64)
    for k, step in enumerate(_STEPS):
        long += hashes[at + k] * step
    few = np.flatnonzero((count > 0) & (count < SHINGLE))
    short = np.zeros(len(few), np.uint64)
    for k, step in enumerate(_STEPS[:-1]):
        has = count[few] > k
        short[has] += hashes[words[few[has]] + k] * step
    short += count[few].astype(np.uint64)
    row = np.concatenate([np.repeat(np.arange(len(count)), whole), few])
    value = mix(np.concatenate([long, short]))
    order = np.lexsort([value, row])
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(row[new], np.arange(len(bounds)))


def set_keys(values: np.ndarray, bounds: np.ndarray, seed: int = 7) -> np.ndarray:
    """One 64-bit key of each set, 0 for an empty one; keys of different seeds are independent."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values + np.uint64(seed)))])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.int64)


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1) + 0.5) / np.log(RATIO)).astype(np.int64)


def class_end(c: np.ndarray) -> np.ndarray:
    """The largest size of the class."""
    return np.ceil(RATIO ** (c + 1.0) - 0.5).astype(np.int64) - 1


def signatures(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature). Sets of up to three shingles are similar to equal ones only and sign nothing."""
    size = np.diff(bounds)
    out_row, out_sign = [], []
    own = size_class(size)
    below = size_class(-(-size * LEAST // OF))
    for c, rows in ((own, np.flatnonzero(size > 3)), (below, np.flatnonzero((size > 3) & (below < own)))):
        if not len(rows):
            continue
        n, scheme = size[rows], c[rows]
        largest = class_end(scheme)
        cells = -(-largest * 27 // 100) + 1
        # Differences from a partner: the smaller of the two is in the scheme's class.
        allowed = np.where(scheme == own[rows], np.maximum(n + n * OF // LEAST, 2 * n) // 9, (np.minimum(n, largest) + n) // 9)
        which = np.repeat(np.arange(len(rows)), n)
        h = values[expand(bounds[rows], n)]
        cell = ((h >> np.uint64(32)) * cells[which].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        first = np.ones(len(h), bool)
        first[1:] = (which[1:] != which[:-1]) | (cell[1:] != cell[:-1])
        begin = np.flatnonzero(first)
        content = np.add.reduceat(mix(h ^ np.uint64(0x5BD1E995)), begin)
        who, where = which[begin], cell[begin]
        full = np.bincount(who, minlength=len(rows))
        sparse = np.flatnonzero(full <= allowed)  # here equal parts may all be empty: empty ones sign, too
        if len(sparse):
            every = np.repeat(sparse, cells[sparse])
            spot = expand(np.zeros(len(sparse), np.int64), cells[sparse])
            taken = np.isin(every * (1 << 32) + spot, who * (1 << 32) + where)
            who, where, content = (np.concatenate(x) for x in ((who, every[~taken]), (where, spot[~taken]), (content, np.zeros(int((~taken).sum()), np.uint64))))
        sign = mix(content + mix(scheme[who].astype(np.uint64) * np.uint64(1 << 32) + where.astype(np.uint64)))
        order = np.lexsort([sign, who])
        who, sign = who[order], sign[order]
        rank = np.arange(len(who)) - np.searchsorted(who, np.arange(len(rows)))[who]
        keep = rank <= np.where(full > allowed, allowed, len(who))[who]
        out_row.append(rows[who[keep]])
        out_sign.append(sign[keep])
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_row), np.concatenate(out_sign)


def chained(sign: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, their least key, edges from the least key to the others)."""
    order = np.lexsort([key, sign])
    sign, key = sign[order], key[order]
    new = np.ones(len(sign), bool)
    new[1:] = sign[1:] != sign[:-1]
    head = key[new][np.cumsum(new) - 1] if len(key) else key
    edges = np.stack([key, head], axis=1)[key != head]
    return sign[new], key[new], np.unique(edges, axis=0) if len(edges) else edges


def _rows(items: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i[0] for i in items], pa.int32()), pa.array([i[1] for i in items], pa.int32()), pa.array([i[2] for i in items], pa.binary())], ["kind", "bucket", "blob"])


def _signed(sign: np.ndarray, key: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Signatures with the least key of each, by bucket, and the edges to the other keys."""
    got, least, edges = chained(sign, key)
    items = [(EDGES, int(len(got)) % buckets, edges.astype("<i8").tobytes())]
    bucket = (got % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort([least, bucket])
    got, least, bucket = got[order], least[order], bucket[order]
    for a, b in zip(*_runs(bucket)):
        names, index = np.unique(least[a:b], return_inverse=True)
        # 48 bits tell signatures of a bucket apart well enough: a clash only makes a block larger.
        short = (got[a:b] >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        items.append((SIGNS, int(bucket[a]), np.array([len(names), b - a], "<u4").tobytes() + names.astype("<i8").tobytes() + short.tobytes() + index.astype("<u4").tobytes()))
    return _rows(items)


def sign(docs: DataFrame, buckets: int, key_bits: int = 64) -> DataFrame:
    """Signatures by bucket, the classes of documents, and edges that a task finds by itself."""
    mask = np.int64((1 << key_bits) - 1 if key_bits < 64 else -1)

    def run(batches):
        give_back(kept_too=True)
        turn = TaskContext.get().partitionId()
        for batch in batches:
            texts = column(batch, "text")
            ids, hashes = document_keys(batch, texts)
            signs, keys, held = [], [], 0
            for row, end, data, bounds in pieces(texts, PIECE_BYTES):
                values, at = shingle_sets(data, bounds)
                table = np.zeros(end - row, DOC)
                table["doc"], table["th"], table["n"] = ids[row:end], hashes[row:end], np.diff(at)
                table["k"] = key = set_keys(values, at) & mask
                table["k2"] = second = set_keys(values, at, 0x2545F4914F6CDD1D)
                turn += 1
                yield _rows([(DOCS, turn % buckets, table.tobytes())])
                one = np.zeros(len(key), bool)
                one[np.unique(second, return_index=True)[1]] = True
                owner, got = signatures(values, at)
                signs.append(got[one[owner]])
                keys.append(key[owner[one[owner]]])
                held += len(got)
                if held > HELD or end == len(texts):
                    yield _signed(np.concatenate(signs), np.concatenate(keys), buckets)
                    signs, keys, held = [], [], 0

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return begin, np.append(begin[1:], len(values))


def _blob(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Columns beside keys, the keys written once: number of keys, of rows, keys, indexes, columns."""
    names, index = np.unique(keys, return_inverse=True)
    return np.array([len(names), len(keys)], "<u4").tobytes() + names.astype("<i8").tobytes() + index.astype("<u4").tobytes() + b"".join(c.tobytes() for c in columns)


def _unblob(blob, *kinds: str) -> list[np.ndarray]:
    m, n = np.frombuffer(blob, "<u4", 2).tolist()
    at = 8 + 8 * m
    out = [np.frombuffer(blob, "<i8", m, 8)[np.frombuffer(blob, "<u4", n, at)]]
    at += 4 * n
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(p) for p in zip(*parts)]


def _split(bucket: np.ndarray, keys: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket, keys, columns = bucket[order], keys[order], [c[order] for c in columns]
    rows = [(int(bucket[a]), _blob(keys[a:b], *(c[a:b] for c in columns))) for a, b in zip(*_runs(bucket))]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "found"])


def _place(values: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(values.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _sets_of(keys: list[int], raw: list[bytes]):
    """(keys, values, bounds) of some texts at a time."""
    squeezed = pa.array(raw, pa.large_binary())
    for row, end, data, bounds in pieces(squeezed, PIECE_BYTES):
        values, at = shingle_sets(data, bounds)
        yield np.array(keys[row:end], np.int64), values, at


def _unzipped(column) -> list[bytes]:
    return [zstandard.ZstdDecompressor().decompress(b.as_py()) for b in column]


BLOBS = "bucket int, found binary"


def near_edges(members: DataFrame, buckets: int) -> DataFrame:
    """Edges a, b between members (n, k, blob) that share one of their rarest n-grams and may be similar by size.

    N-grams are counted with sums in each task first.  Those that more than one in FREQUENT of all
    places of members hold, FREQUENT at most, are then sent to every task; only pairs of a member and
    one of the other n-grams meet their counts by a shuffle, so that no n-gram fills a bucket.
    """
    total = members.agg(F.sum("n")).first()[0] or 0
    limit = max(OFTEN, total // FREQUENT)

    def tally(batches):
        give_back()
        for batch in batches:
            got, held = [], 0
            for _, values, _ in _sets_of(batch.column(0).to_pylist(), _unzipped(batch.column(1))):
                got.append(values)
                held += len(values)
                if held > HELD:
                    yield _summed(got, buckets)
                    got, held = [], 0
            if got:
                yield _summed(got, buckets)

    def add(table):
        counts, values = _joined([_unblob(b.as_buffer(), "<u8") for b in table.column("found").combine_chunks()])
        order = np.argsort(values, kind="stable")
        counts, values = counts[order], values[order]
        begin, _ = _runs(values)
        values, counts = values[begin], np.add.reduceat(counts, begin)
        values, counts = values[counts > 1], counts[counts > 1]
        often = counts > limit
        raw = pa.array([values[often].astype("<u8").tobytes() + counts[often].astype("<i8").tobytes()], pa.binary())
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "found": pa.array([_blob(counts[~often], values[~often])], pa.binary()), "often": raw})

    counts = written(members.select("k", "blob").mapInArrow(tally, BLOBS).groupBy("bucket").applyInArrow(add, BLOBS + ", often binary"), "ngram-counts")
    lists = [bytes(r.often) for r in counts.where(F.length("often") > 0).select("often").collect()]  # FREQUENT numbers at most
    common = np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(x, "<u8", len(x) // 16) for x in lists)])
    times = np.concatenate([np.zeros(0, "<i8"), *(np.frombuffer(x, "<i8", len(x) // 16, len(x) // 2) for x in lists)])
    times, common = times[np.argsort(common)], np.sort(common)

    def spell(batches, frequent: bool):
        """Members and n-grams by bucket of the n-gram, or those of the frequent n-grams, with their counts, by bucket of the member."""
        give_back()
        for batch in batches:
            for keys, values, at in _sets_of(batch.column(0).to_pylist(), _unzipped(batch.column(1))):
                keys = keys[row_of(at)]
                place = np.minimum(np.searchsorted(common, values), max(len(common) - 1, 0))
                known = common[place] == values if len(common) else np.zeros(len(values), bool)
                if frequent:
                    keys, values, often = keys[known], values[known], np.minimum(times[place[known]], 0xFFFFFFFF)
                    yield _split(_place(keys, buckets), keys, values, often.astype("<u4"))
                else:
                    yield _split((values[~known] % np.uint64(buckets)).astype(np.int64), keys[~known], values[~known])

    def count(left, right):
        nothing = pa.Table.from_batches([_split(np.zeros(0, np.int64), np.zeros(0, np.int64))])
        if not left.num_rows or not right.num_rows:
            return nothing
        keys, values = _joined([_unblob(b.as_buffer(), "<u8") for b in left.column("found").combine_chunks()])
        often, names = _joined([_unblob(b.as_buffer(), "<u8") for b in right.column("found").combine_chunks()])
        if not len(names):
            return nothing
        order = np.argsort(names)
        often, names = often[order], names[order]
        place = np.minimum(np.searchsorted(names, values), len(names) - 1)
        several = names[place] == values
        keys, values, often = keys[several], values[several], np.minimum(often[place[several]], 0xFFFFFFFF)
        return pa.Table.from_batches([_split(_place(keys, buckets), keys, values, often.astype("<u4"))])

    def prefix(left, right):
        raw = dict(zip(left.column("k").to_pylist(), left.column("blob").to_pylist()))
        out = [[], [], []]
        where = {}
        if raw and right.num_rows:
            keys, values, often = _joined([_unblob(b.as_buffer(), "<u8", "<u4") for b in right.column("found").combine_chunks()])
            order = np.lexsort([values, keys])
            keys, values, often = keys[order], values[order], often[order]
            begin, end = _runs(keys)
            where = {int(keys[a]): (a, b) for a, b in zip(begin, end)}
        for name, blob in raw.items():
            span = where.get(name)
            if span is None:
                continue
            text = pa.array([zstandard.ZstdDecompressor().decompress(blob)], pa.large_binary())
            own = np.concatenate([shingle_sets(data, at)[0] for _, _, data, at in pieces(text, PIECE_BYTES)])
            n = len(own)
            rare = n - (span[1] - span[0])  # n-grams of no other member come first
            take = max(0, n - -(-n * LEAST // OF) + 1 - rare)
            some = np.lexsort([values[span[0] : span[1]], often[span[0] : span[1]]])[:take] + span[0]
            out[0].append(np.full(len(some), name))
            out[1].append(values[some])
            out[2].append(np.full(len(some), n, "<u4"))
        keys, values, sizes = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in zip(out, (np.int64, np.uint64, np.uint32)))
        # Members of one size that share an n-gram are chained here, and one of them goes on.
        order = np.lexsort([keys, sizes, values])
        keys, values, sizes = keys[order], values[order], sizes[order]
        first = np.ones(len(keys), bool)
        first[1:] = (values[1:] != values[:-1]) | (sizes[1:] != sizes[:-1])
        head = keys[first][np.cumsum(first) - 1] if len(keys) else keys
        edges = np.unique(np.stack([head[~first], keys[~first]], axis=1), axis=0).reshape(-1, 2)
        sent = _split((values[first] % np.uint64(buckets)).astype(np.int64), keys[first], values[first], sizes[first].astype("<u4"))
        rows = [(b, None, pairs) for b, pairs in parts(edges.astype("<i8"), _place(edges[:, 1], buckets))]
        rows += list(zip(sent.column(0).to_pylist(), sent.column(1).to_pylist(), [None] * sent.num_rows))
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate([("bucket", pa.int32()), ("found", pa.binary()), ("edges", pa.binary())])})

    def chain(table):
        pairs = [np.zeros((0, 2), np.int64)] + [np.frombuffer(b.as_buffer(), "<i8").reshape(-1, 2) for b in table.column("edges").combine_chunks() if b.is_valid]
        sent = [_unblob(b.as_buffer(), "<u8", "<u4") for b in table.column("found").combine_chunks() if b.is_valid]
        if sent:
            keys, values, sizes = _joined(sent)
            order = np.lexsort([keys, sizes, values])
            keys, values, sizes = keys[order], values[order], sizes[order].astype(np.int64)
            close = (values[1:] == values[:-1]) & (OF * sizes[:-1] >= LEAST * sizes[1:])
            pairs.append(np.stack([keys[:-1], keys[1:]], axis=1)[close])
        pairs = np.unique(np.concatenate(pairs), axis=0).reshape(-1, 2)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    texts = members.select("k", "blob")
    counted = texts.mapInArrow(lambda b: spell(b, False), BLOBS).groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(count, BLOBS)
    if len(common):
        counted = counted.unionByName(texts.mapInArrow(lambda b: spell(b, True), BLOBS))
    prefixes = members.select("place", "k", "blob").groupBy("place").cogroup(counted.groupBy("bucket")).applyInArrow(prefix, BLOBS + ", edges binary")
    return prefixes.groupBy("bucket").applyInArrow(chain, "a long, b long").where("a <> b")


def _summed(values: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    names, n = np.unique(np.concatenate(values), return_counts=True)
    return _split((names % np.uint64(buckets)).astype(np.int64), n.astype(np.int64), names)


def block_edges(signed: DataFrame) -> DataFrame:
    def run(key, table):
        kind, blobs = key[0].as_py(), [b.as_buffer() for b in table.column("blob").combine_chunks()]
        if kind != SIGNS:
            return table
        signs, keys = [], []
        for blob in blobs:
            m, n = np.frombuffer(blob, "<u4", 2).tolist()
            names = np.frombuffer(blob, "<i8", m, 8)
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, 8 + 8 * m).reshape(-1, 6)
            signs.append(wide.view("<u8").ravel())
            keys.append(names[np.frombuffer(blob, "<u4", n, 8 + 8 * m + 6 * n)])
        edges = chained(np.concatenate(signs), np.concatenate(keys))[2]
        return pa.Table.from_batches([_rows([(EDGES, 0, edges.astype("<i8").tobytes())])])

    return signed.groupBy("kind", "bucket").applyInArrow(run, SCHEMA)


def _read(found: DataFrame, kind: int) -> DataFrame:
    def edges(batches):
        for batch in batches:
            for blob in batch.column(0):
                pair = np.frombuffer(blob.as_buffer(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    def documents(batches):
        for batch in batches:
            for blob in batch.column(0):
                rows = np.frombuffer(blob.as_buffer(), DOC)
                yield pa.RecordBatch.from_arrays([pa.array(rows["doc"]), pa.array(rows["th"].astype(np.int64)), pa.array(rows["n"].astype(np.int64)), pa.array(rows["k"]), pa.array(rows["k2"])], ["doc", "th", "n", "k", "k2"])

    rows = found.where(F.col("kind") == kind).select("blob")
    return rows.mapInArrow(edges, "a long, b long") if kind == EDGES else rows.mapInArrow(documents, "doc long, th long, n long, k long, k2 long")


class PrefixTree:
    """A radix tree of sets given as ascending ranks; the sets come in lexicographic order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        # of each node: the set that spells it, where its label starts and ends, its children, sets that end there, parent, living sets below, their least and largest size
        self.spell, self.start, self.end, self.below, self.here, self.up, self.alive, self.least, self.most = [], [], [], [], [], [], [], [], []
        self.home = [0] * len(sets)
        self._node(0, 0, 0, -1)
        path = [0]
        for i, s in enumerate(sets):
            common = 0
            if i:
                before = sets[i - 1]
                n = min(len(before), len(s))
                differ = np.flatnonzero(before[:n] != s[:n])
                common = int(differ[0]) if len(differ) else n
            while len(path) > 1 and self.start[path[-1]] >= common:
                path.pop()
            top = path[-1]
            if self.end[top] > common:  # split its label
                low = self._node(self.spell[top], common, self.end[top], top)
                self.below[low], self.here[low] = self.below[top], self.here[top]
                for child in self.below[low]:
                    self.up[child] = low
                for j in self.here[low]:
                    self.home[j] = low
                self.end[top], self.below[top], self.here[top] = common, [low], []
            if len(s) > common:
                leaf = self._node(i, common, len(s), top)
                self.below[top].append(leaf)
                path.append(leaf)
                top = leaf
            self.here[top].append(i)
            self.home[i] = top
        for node in reversed(sorted(range(len(self.spell)), key=lambda k: self.end[k])):
            sizes = [len(sets[j]) for j in self.here[node]] + [x for c in self.below[node] for x in (self.least[c], self.most[c])]
            self.alive[node] = len(self.here[node]) + sum(self.alive[c] for c in self.below[node])
            self.least[node], self.most[node] = min(sizes), max(sizes)

    def _node(self, spell: int, start: int, end: int, up: int) -> int:
        for values, v in ((self.spell, spell), (self.start, start), (self.end, end), (self.below, []), (self.here, []), (self.up, up), (self.alive, 0), (self.least, 0), (self.most, 0)):
            values.append(v)
        return len(self.spell) - 1

    def remove(self, i: int) -> None:
        node = self.home[i]
        self.here[node] = [j for j in self.here[node] if j != i]
        while node >= 0:
            self.alive[node] -= 1
            node = self.up[node]

    def similar(self, i: int, member: np.ndarray) -> list[int]:
        """Living sets similar to set i; member: True at its ranks."""
        query, sets, found = self.sets[i], self.sets, []
        n, stack = len(query), [(0, 0)]
        while stack:
            node, overlap = stack.pop()
            if not self.alive[node] or OF * self.most[node] < LEAST * n or LEAST * self.least[node] > OF * n:
                continue
            a, b = self.start[node], self.end[node]
            if b > a:
                label = sets[self.spell[node]][a:b]
                overlap += int(np.count_nonzero(member[label]))
                rest = n - int(np.searchsorted(query, label[-1], "right"))
                reach = overlap + min(rest, self.most[node] - b)
                if (OF + LEAST) * reach < LEAST * (n + max(self.least[node], reach)):
                    continue
            for j in self.here[node]:
                if OF * overlap >= LEAST * (n + len(sets[j]) - overlap):
                    found.append(j)
            stack += [(child, overlap) for child in self.below[node]]
        return found


def linked(values: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the similarity links among these sets."""
    size = np.diff(bounds)
    rows = row_of(bounds)
    _, token, df = np.unique(values, return_inverse=True, return_counts=True)
    rare = np.lexsort([token, df[token], rows])  # each set's shingles, the rarest first
    prefix = size - -(-size * LEAST // OF) + 1
    place = np.arange(len(rows)) - bounds[:-1][rows]
    keep = (place < prefix[rows]) & (df[token[rare]] > 1)
    tok, who = token[rare][keep], rows[keep]
    order = np.lexsort([size[who], tok])
    tok, who = tok[order], who[order]
    chain = (tok[1:] == tok[:-1]) & (OF * size[who[:-1]] >= LEAST * size[who[1:]])
    pairs = np.unique(np.stack([who[:-1], who[1:]], axis=1)[chain], axis=0) if len(tok) else []
    parent = list(range(len(size)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs.tolist() if len(pairs) else ():
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
    groups: dict[int, list[int]] = {}
    for x in range(len(size)):
        groups.setdefault(root(x), []).append(x)
    links = []
    for group in groups.values():
        if len(group) == 1:
            continue
        local = [token[bounds[x] : bounds[x + 1]] for x in group]
        names, index, often = np.unique(np.concatenate(local), return_inverse=True, return_counts=True)
        rank = np.empty(len(names), np.int64)
        rank[np.lexsort([names, -often])] = np.arange(len(names))  # common n-grams first
        cuts = np.cumsum([len(x) for x in local])[:-1]
        ranked = [np.sort(x) for x in np.split(rank[index], cuts)]
        by = sorted(range(len(group)), key=lambda i: ranked[i].astype(">u4").tobytes())
        tree = PrefixTree([ranked[i] for i in by])
        member = np.zeros(len(names), bool)
        left = set(range(len(by)))
        while left:
            queue = [left.pop()]
            tree.remove(queue[0])
            while queue:
                i = queue.pop()
                member[tree.sets[i]] = True
                for j in tree.similar(i, member):
                    links.append((group[by[i]], group[by[j]]))
                    tree.remove(j)
                    left.discard(j)
                    queue.append(j)
                member[tree.sets[i]] = False
    return links


def join_units(units: DataFrame) -> DataFrame:
    """Links (a, b) between classes in each unit. units: unit, blob of a text and k, its class."""

    def run(table):
        keys = table.column("k").to_numpy()
        first = np.unique(keys, return_index=True)[1].tolist()
        keys, blobs = keys[first], table.column("blob")
        values, sizes = [], [0]
        for at in range(0, len(first), 256):
            for _, got, bounds in _sets_of(first[at : at + 256], _unzipped(blobs[i] for i in first[at : at + 256])):
                values.append(got)
                sizes += np.diff(bounds).tolist()
        links = linked(np.concatenate(values), np.cumsum(sizes))
        return pa.table({"a": pa.array([int(keys[a]) for a, _ in links], pa.int64()), "b": pa.array([int(keys[b]) for _, b in links], pa.int64())})

    return units.select("unit", "k", "blob").groupBy("unit").applyInArrow(run, "a long, b long")


def fetch(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(n, k, blob) of the members (bucket, doc, th, k, n): their texts, compressed."""

    def run(left, right):
        wanted = dict(zip(zip(left.column("doc").to_pylist(), left.column("th").to_pylist()), zip(left.column("n").to_pylist(), left.column("k").to_pylist())))
        squeeze = zstandard.ZstdCompressor(level=1)
        out = [[], [], []]
        for _, doc, th, text in unpacked(right) if wanted else ():
            got = wanted.pop((doc, th), None)
            if got:
                for values, v in zip(out, (*got, squeeze.compress(text))):
                    values.append(v)
        return pa.table({"n": pa.array(out[0], pa.int64()), "k": pa.array(out[1], pa.int64()), "blob": pa.array(out[2], pa.binary())})

    return members.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInArrow(run, "n long, k long, blob binary")


def _across(members: DataFrame, links: DataFrame, shard: int) -> DataFrame:
    """Links of the blocks that are joined in shards, between what their shards hold apart."""
    labels = components(links)
    named = lambda: members.join(labels.withColumnRenamed("node", "k"), "k", "left").withColumn("label", F.coalesce("label", "k"))
    heads = named().groupBy("block", "shard", "label").agg(F.min_by("k", "k").alias("k"), F.min_by("n", "k").alias("n"))
    many = heads.groupBy("block").agg(F.ceil(F.sum("n") / shard).alias("parts"))
    few = members.join(heads.join(many, "block").select("k", "parts"), "k").withColumn("unit", F.concat_ws("-", F.lit("h"), "block", F.pmod(F.xxhash64("k", F.lit(1)), "parts")))
    links = checkpoint(links.unionByName(join_units(few)))
    labels = components(links)
    state = checkpoint(named().select("block", "shard", "k", "n", "label"))
    sizes = state.groupBy("block", "label").count().withColumn("nth", F.row_number().over(W.partitionBy("block").orderBy(F.desc("count"), "label")))
    rest = state.join(sizes.where("nth > 1").select("block", "label"), ["block", "label"]).select("block", "k", "n")
    rest = rest.withColumn("part", F.pmod(F.xxhash64("k", F.lit(3)), F.lit(1 << 20)))
    counted = rest.groupBy("block").agg(F.ceil(F.sum("n") / shard).alias("chunks"))
    rest = checkpoint(rest.join(counted, "block").select("block", "k", (F.col("part") % F.col("chunks")).alias("chunk")))
    meets = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("s")
    left = members.join(rest.select("k", "chunk"), "k").select("block", "k", "blob", "chunk", meets)
    right = members.join(counted, "block").select("block", "k", "blob", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("shard").alias("s"))
    units = left.unionByName(right.select("block", "k", "blob", "chunk", "s")).withColumn("unit", F.concat_ws("-", "block", "chunk", "s"))
    return checkpoint(links.unionByName(join_units(units)))


def _apart(classes: DataFrame, paired: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes and the keys that are in blocks, with a key of their own for sets that share the first 64 bits by chance."""
    shared = classes.where("n > 0").groupBy("k").agg(F.min("k2").alias("least"), F.max("k2").alias("most")).where("least <> most").select("k")
    if shared.isEmpty():
        return classes, paired
    renamed = checkpoint(classes.where("n > 0").join(shared, "k").select("k", "k2").distinct().withColumn("own", F.xxhash64("k", "k2")))
    every = renamed.select(F.col("own").alias("k")).unionByName(paired.join(shared, "k", "left_anti"))
    return classes.join(renamed, ["k", "k2"], "left").withColumn("k", F.coalesce("own", "k")).drop("own"), every


def groups(docs: DataFrame, shard: int = SHARD, key_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id. key_bits: of the first half of the key, fewer in tests only."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 32 + int(size // BUCKET_BYTES)
    found = written(block_edges(sign(docs, buckets, key_bits)), "ngram-blocks")
    classes = _read(found, DOCS)
    paired = _read(found, EDGES)
    paired = paired.select(F.col("a").alias("k")).unionByName(paired.select(F.col("b").alias("k"))).distinct()
    classes, paired = _apart(classes, paired)
    reps = classes.where("n > 0").groupBy("k").agg(F.min(F.struct("doc", "th")).alias("at"), F.max("n").alias("n"))
    members = reps.join(paired, "k").select(F.col("at.doc").alias("doc"), F.col("at.th").alias("th"), "k", "n")
    fetched = fetch(_bucketed(members, buckets), packed(docs, buckets))
    known = written(_placed(fetched, buckets), "ngram-members")
    blocks = checkpoint(components(near_edges(known, buckets)))
    sizes = blocks.withColumnRenamed("node", "k").join(known.select("k", "n"), "k").groupBy(F.col("label").alias("block")).agg(F.sum("n").alias("size"))
    shards = F.ceil(F.col("size") / shard).cast("long")
    named = blocks.select(F.col("node").alias("k"), F.col("label").alias("block")).join(sizes, "block").withColumn("shards", shards)
    named = checkpoint(named.withColumn("shard", F.pmod(F.xxhash64("k"), F.col("shards"))))
    total = named.where("shards = 1").join(known.select("k", "n"), "k").agg(F.sum("n")).first()[0] or 0
    bags = 1 + 3 * int(total // shard)
    unit = F.when(F.col("shards") == 1, F.concat_ws("-", F.lit("b"), F.pmod(F.xxhash64("block"), F.lit(bags)))).otherwise(F.concat_ws("-", F.lit("s"), "block", "shard"))
    links = checkpoint(join_units(known.join(named.withColumn("unit", unit), "k").select("unit", "k", "blob")))
    large = named.where("shards > 1")
    if not large.isEmpty():
        links = _across(known.join(large, "k"), links, shard)
    # Classes are nodes in the order of their first documents, so that a component's label holds its first document.
    nodes = reps.select("k", F.struct("at.doc", "at.th", "k").alias("node"))
    for end in ("a", "b"):
        links = links.join(nodes.select(F.col("k").alias(end), F.col("node").alias(f"node_{end}")), end)
    labels = components(links.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    least = reps.select("k", "at").join(labels.select(F.col("node.k").alias("k"), F.col("label.doc").alias("least")), "k", "left").select("k", F.coalesce("least", "at.doc").alias("least"))
    full = classes.where("n > 0").join(least, "k").select("doc", "n", "least")
    joined = full.unionByName(classes.where("n = 0").select("doc", "n", F.col("doc").alias("least")))
    real = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return joined.select(real("doc").alias("doc_id"), F.col("n").alias("n_shingles"), real("least").alias("component_id"))


def _placed(fetched: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_place(batch.column(1).to_numpy(), buckets).astype(np.int32)), *batch.columns], ["place", *batch.schema.names])

    return fetched.mapInArrow(run, "place int, n long, k long, blob binary")


def _bucketed(members: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(doc_bucket(batch.column(0).to_numpy(), buckets).astype(np.int32)), *batch.columns], ["bucket", *batch.schema.names])

    return members.mapInArrow(run, "bucket int, doc long, th long, k long, n long")


def apply(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """The documents with one of each group, the first by doc_id."""
    gone = groups(docs.select("doc_id", "text"), shard).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
