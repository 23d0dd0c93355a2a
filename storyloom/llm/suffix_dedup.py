"""Removal of every byte covered by a string of LENGTH bytes that also starts earlier.

Every window of LENGTH bytes has an anchor: the leftmost smallest hash among its GRAM-byte
strings.  Equal windows have equal anchors at the same distance, so windows need only be
compared within the group of one anchor string, and consecutive windows of one anchor (a
stretch) travel together.

1. Tasks find stretches and send their hashes, 34 bytes each, by the hash of the whole stretch.  Copies
   of a whole stretch, known by two 64-bit hashes (of the anchor and of everything), are
   pre-aggregated to the first of them, within a task before anything is sent.
2. One stretch of each kind goes on, to the bucket of its anchor.  Where stretches of one anchor
   differ, each asks for its bytes.
3. In each group the windows of these stretches are put in suffix order to LENGTH bytes.  Previous
   and next smaller positions in that order give each window's longest previous factor; those that
   reach LENGTH have an earlier match.
4. The ranges found meet their text, which is cut and hashed.

A passage that stands in very many texts between different neighbours gives very many kinds of one anchor.
Kinds are spread evenly in step 1, so an anchor that a bucket there sees often, by what KINDS in all would give, has too many
for a group.  The up to HOTS most seen of these go another way: their windows are compared by 128-bit
hashes.  A task keeps the first window of each hash and removes the others; the first ones of all tasks meet
by the hash, so a passage reaches its bucket once from each task.

Work is split by hashes of stretches, anchors, windows and documents into a number of buckets that grows with
the text.

Order is by doc_id (null last), then the text's hash, then place.  Defined results: a null
text is an empty one; rows with equal doc_id and text count as one document, and each gets its
result.  A text of any length counts as a whole, its stretches taken apart.  An empty table gives an
empty result.  Columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import written
from storyloom.llm.ragged import PIECE_BYTES, column, expand, mix, pieces, prefix_sums, span_hashes
from storyloom.llm.texts import doc_bucket, document_keys, packed, parts, unpacked

LENGTH = 100
GRAM = 24
BUCKET_BYTES = 12_000_000
STRETCH = np.dtype([("fp", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("th", "<u4"), ("lo", "<u4"), ("w", "u1"), ("o", "u1")])
ASK = np.dtype([("fp", "<u8"), ("doc", "<i8"), ("th", "<u4"), ("lo", "<u4"), ("w", "u1"), ("o", "u1")])
RANGE = np.dtype([("doc", "<i8"), ("th", "<u4"), ("a", "<u4"), ("b", "<u4")])
WINDOW = np.dtype([("h", "<u8"), ("g", "<u8"), ("doc", "<i8"), ("th", "<u4"), ("a", "<u4")])
RANGES, ASKS, HOT, SHARED = 0, 1, 2, 3
HIGH = np.uint64(0xFFFFFFFF00000000)
LOW = np.uint64(0xFFFFFFFF)
WINDOWS = 150_000
#: Stretches that a task settles before it sends them.
HELD = 300_000
#: Kinds of stretches of one anchor that a group takes, about; anchors with more that every task is told, at most.
KINDS = 4000
HOTS = 1_000_000


def stretches(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, lo, hi (starts of the first and last window), anchor, hash of the anchor, hash of the stretch."""
    counts = np.maximum(np.diff(bounds) - LENGTH + 1, 0)
    starts = expand(bounds[:-1], counts)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    sums = prefix_sums(data)
    places = np.arange(len(data) - GRAM + 1)
    grams = span_hashes(sums, places, places + GRAM)
    least, size, span = (grams & HIGH) | places.astype(np.uint64), 1, LENGTH - GRAM + 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: size - span], least[span - size :])
    anchor = (least & LOW).astype(np.int64)[starts]
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.ones(len(starts), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(starts)) - 1
    lo, hi, at = starts[begin], starts[end], anchor[begin]
    return row[begin], lo, hi, at, grams[at], mix(span_hashes(sums, lo, hi + LENGTH) + (at - lo).astype(np.uint64))


def settle(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first stretch of each kind in order of its anchor, ranges of the later copies)."""
    found = found[np.lexsort([found[k] for k in ("lo", "th", "doc", "ctx", "fp")])]
    new = np.ones(len(found), bool)
    kind = np.ones(len(found), bool)
    if len(found) > 1:
        kind[1:] = (found["fp"][1:] != found["fp"][:-1]) | (found["ctx"][1:] != found["ctx"][:-1])
        new[1:] = kind[1:]
        for k in ("doc", "th", "lo"):
            new[1:] |= found[k][1:] != found[k][:-1]
    head = np.maximum.accumulate(np.where(kind, np.arange(len(found)), 0))
    own = np.ones(len(found), bool)  # a repeated row is the first occurrence itself, not a copy
    for k in ("doc", "th", "lo"):
        own &= found[k] == found[k][head]
    later = found[new & ~own]
    ranges = np.zeros(len(later), RANGE)
    for k in ("doc", "th"):
        ranges[k] = later[k]
    ranges["a"] = later["lo"]
    ranges["b"] = later["lo"] + later["w"] + LENGTH
    return found[kind], ranges


def merged(ranges: np.ndarray) -> np.ndarray:
    """The ranges of each document, sorted, those that touch or overlap as one."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.lexsort([ranges[k] for k in ("a", "th", "doc")])]
    doc = np.ones(len(ranges), bool)
    doc[1:] = (ranges["doc"][1:] != ranges["doc"][:-1]) | (ranges["th"][1:] != ranges["th"][:-1])
    shift = np.cumsum(doc).astype(np.int64) << 33
    reach = np.maximum.accumulate(ranges["b"] + shift)
    first = doc.copy()
    first[1:] |= (ranges["a"] + shift)[1:] > reach[:-1]
    begin = np.flatnonzero(first)
    out = ranges[begin]
    last = np.append(begin[1:], len(ranges)) - 1
    out["b"] = (reach - shift)[last]
    return out


def rows_of(items: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i[0] for i in items], pa.int32()), pa.array([i[1] for i in items], pa.int32()), pa.array([i[2] for i in items], pa.binary())], ["kind", "bucket", "blob"])


SCHEMA = "kind int, bucket int, blob binary"


def find(docs: DataFrame, buckets: int) -> DataFrame:
    """Stretches by bucket of their whole hash (kind ASKS), and ranges that are settled in the task."""

    def run(batches):
        for batch in batches:
            texts = column(batch, "text")
            ids, hashes = document_keys(batch, texts)
            got, held = [], 0
            for row, end, data, bounds in pieces(texts, PIECE_BYTES):
                at, lo, hi, anchor, fp, ctx = stretches(data, bounds)
                out = np.zeros(len(at), STRETCH)
                start = bounds[at]
                for k, v in (("fp", fp), ("ctx", ctx), ("doc", ids[row + at]), ("th", hashes[row + at]), ("lo", lo - start), ("w", hi - lo), ("o", anchor - lo)):
                    out[k] = v
                got.append(out)
                held += len(out)
                if held < HELD and end < len(texts):
                    continue
                first, ranges = settle(np.concatenate(got))
                got, held = [], 0
                first = first[np.lexsort([first["lo"], first["doc"]])]
                ranges = merged(ranges)
                items = [(ASKS, b, blob) for b, blob in parts(first, (first["ctx"] % np.uint64(buckets)).astype(np.int64))]
                yield rows_of(items + [(RANGES, b, blob) for b, blob in parts(ranges, doc_bucket(ranges["doc"], buckets))])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def resolve(found: DataFrame, buckets: int) -> DataFrame:
    """Ranges of copied stretches; one stretch of each kind, by bucket of its anchor (ASKS); anchors seen often here (HOT)."""
    often = max(2, KINDS // buckets)

    def run(key, table):
        blobs = [b.as_buffer() for b in table.column("blob").combine_chunks()] if table.num_rows else []
        if key[0].as_py() == RANGES:
            return pa.Table.from_batches([rows_of([(RANGES, key[1].as_py(), merged(np.concatenate([np.frombuffer(b, RANGE) for b in blobs])).tobytes())])])
        first, ranges = settle(np.concatenate([np.frombuffer(b, STRETCH) for b in blobs]))
        kinds = np.zeros(len(first), ASK)
        for k in ASK.names:
            kinds[k] = first[k]
        items = [(ASKS, b, blob) for b, blob in parts(kinds, (kinds["fp"] % np.uint64(buckets)).astype(np.int64))]
        ranges = merged(ranges)
        items += [(RANGES, b, blob) for b, blob in parts(ranges, doc_bucket(ranges["doc"], buckets))]
        anchors, n = np.unique(kinds["fp"], return_counts=True)
        if (n >= often).any():
            items.append((HOT, 0, anchors[n >= often].astype("<u8").tobytes()))
        return pa.Table.from_batches([rows_of(items)])

    return found.groupBy("kind", "bucket").applyInArrow(run, SCHEMA)


def hot_anchors(found: DataFrame) -> np.ndarray:
    """The anchors that most buckets have seen often, HOTS at most, ascending."""

    def run(batches):
        for batch in batches:
            for blob in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(blob.as_buffer(), "<u8").view("<i8"))], ["fp"])

    seen = found.where(F.col("kind") == HOT).select("blob").mapInArrow(run, "fp long").groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    best = seen.orderBy(F.desc("n"), "fp").limit(HOTS).select("fp").toArrow().column("fp").to_numpy()  # HOTS numbers
    return np.sort(best.view("<u8"))


def grouped(found: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """Wishes for bytes by bucket of their document: of kinds that share their anchor (ASKS), and of hot anchors (HOT)."""
    told = found.sparkSession.sparkContext.broadcast(hot)

    def split(batches):
        for batch in batches:
            items = []
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                kinds = np.frombuffer(blob.as_buffer(), ASK)
                place = np.minimum(np.searchsorted(told.value, kinds["fp"]), max(len(told.value) - 1, 0))
                known = told.value[place] == kinds["fp"] if len(told.value) else np.zeros(len(kinds), bool)
                if not known.all():
                    items.append((ASKS, bucket, kinds[~known].tobytes()))
                items += [(HOT, b, part) for b, part in parts(kinds[known], doc_bucket(kinds["doc"][known], buckets))]
            yield rows_of(items)

    def several(table):
        kinds = np.concatenate([np.frombuffer(b.as_buffer(), ASK) for b in table.column("blob").combine_chunks()])
        kinds = kinds[np.argsort(kinds["fp"], kind="stable")]
        new = np.ones(len(kinds), bool)
        new[1:] = kinds["fp"][1:] != kinds["fp"][:-1]
        group = np.cumsum(new) - 1
        asks = kinds[np.bincount(group)[group] > 1]
        return pa.Table.from_batches([rows_of([(ASKS, b, blob) for b, blob in parts(asks, doc_bucket(asks["doc"], buckets))])])

    dealt = found.where(F.col("kind") == ASKS).select("bucket", "blob").mapInArrow(split, SCHEMA)
    asks = dealt.where(F.col("kind") == ASKS).groupBy("bucket").applyInArrow(several, SCHEMA)
    return asks.unionByName(dealt.where(F.col("kind") == HOT)) if len(hot) else asks


def by_document(records: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    if not len(records):
        return {}
    records = records[np.lexsort([records["th"], records["doc"]])]
    new = np.concatenate([[True], (records["doc"][1:] != records["doc"][:-1]) | (records["th"][1:] != records["th"][:-1])])
    begin = np.flatnonzero(new)
    return {(int(records["doc"][a]), int(records["th"][a])): records[a:b] for a, b in zip(begin, [*begin[1:], len(records)])}


ANSWER = "kind int, bucket int, asks binary, blob binary"


def _answers(items: list[tuple[int, int, bytes | None, bytes]]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table({n: pa.array([i[k] for i in items], t) for k, (n, t) in enumerate(zip(("kind", "bucket", "asks", "blob"), kinds))})


def answer(asks: DataFrame, texts: DataFrame, buckets: int) -> DataFrame:
    """The bytes of the stretches asked for, by bucket of their anchor; of hot anchors, ranges and the first windows of the task, by hash."""

    def run(left, right):
        want = {ASKS: [np.zeros(0, ASK)], HOT: [np.zeros(0, ASK)]}
        for kind, blob in zip(left.column("kind").to_pylist(), left.column("blob").combine_chunks() if left.num_rows else ()):
            want[kind].append(np.frombuffer(blob.as_buffer(), ASK))
        asked, hot = (by_document(np.concatenate(want[kind])) for kind in (ASKS, HOT))
        done, records, raw, items = set(), [], [], []
        shared, held = [], 0
        for _, doc, th, text in unpacked(right) if asked or hot else ():
            if (doc, th) in done:
                continue
            for wanted in (asked, hot):
                some = wanted.get((doc, th))
                if some is None:
                    continue
                done.add((doc, th))
                bytes_ = [bytes(text[a : a + w + LENGTH]) for a, w in zip(some["lo"].tolist(), some["w"].tolist())]
                if wanted is asked:
                    records.append(some)
                    raw += bytes_
                else:
                    shared.append(windows(some, np.frombuffer(b"".join(bytes_), np.uint8)))
                    held += len(shared[-1])
                    if held > 8 * HELD:
                        first, ranges = first_windows(np.concatenate(shared))
                        items += [(RANGES, b, None, blob) for b, blob in parts(ranges, doc_bucket(ranges["doc"], buckets))]
                        shared, held = [first], 0
        if shared:
            first, ranges = first_windows(np.concatenate(shared))
            items += [(RANGES, b, None, blob) for b, blob in parts(ranges, doc_bucket(ranges["doc"], buckets))]
            items += [(SHARED, b, None, blob) for b, blob in parts(first, (first["g"] % np.uint64(buckets)).astype(np.int64))]
        if records:
            records = np.concatenate(records)
            bucket = (records["fp"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
            squeeze = zstandard.ZstdCompressor(level=1)
            for a, b in zip(edges, [*edges[1:], len(order)]):
                some = order[a:b]
                items.append((ASKS, int(bucket[some[0]]), records[some].tobytes(), squeeze.compress(b"".join(raw[i] for i in some))))
        return _answers(items)

    return asks.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInArrow(run, ANSWER)


def block_hashes(data: np.ndarray, length: int, seed: int) -> np.ndarray:
    """64-bit hashes of the blocks of this length at every place, mixed from those of shorter blocks; no polynomial."""
    size, have = 1, mix(np.arange(256, dtype=np.uint64) + np.uint64(seed))[data]
    out, done = None, 0
    while True:
        if length & size:
            part = have[done : len(have)] if out is None else have[done : done + len(out)]
            out = part if out is None else mix(out[: len(part)] * np.uint64(0xD6E8FEB86659FD93) + part)
            done += size
        if 2 * size > length:
            return out[: max(0, len(data) - length + 1)]
        have = mix(have[:-size] * np.uint64(0x9FB21C651E98DF25) + have[size:]) if len(have) > size else have[:0]
        size *= 2


def windows(records: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The windows of these stretches, whose bytes follow each other in data."""
    length = records["w"].astype(np.int64) + LENGTH
    count = records["w"].astype(np.int64) + 1
    owner, place = np.repeat(np.arange(len(records)), count), expand(np.zeros(len(records), np.int64), count)
    start = (np.cumsum(length) - length)[owner] + place
    out = np.zeros(len(start), WINDOW)
    out["h"], out["g"] = block_hashes(data, LENGTH, 1)[start], block_hashes(data, LENGTH, 0x5851F42D4C957F2D)[start]
    for k in ("doc", "th"):
        out[k] = records[k][owner]
    out["a"] = records["lo"][owner] + place
    return out


def first_windows(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first window of each hash, merged ranges of the others)."""
    found = found[np.lexsort([found[k] for k in ("a", "th", "doc", "h", "g")])]
    new = np.ones(len(found), bool)
    new[1:] = (found["g"][1:] != found["g"][:-1]) | (found["h"][1:] != found["h"][:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(found)), 0))
    own = np.ones(len(found), bool)  # windows of two stretches may be the same one
    for k in ("doc", "th", "a"):
        own &= found[k] == found[k][head]
    later = found[~own]
    ranges = np.zeros(len(later), RANGE)
    for k in ("doc", "th", "a"):
        ranges[k] = later[k]
    ranges["b"] = later["a"] + LENGTH
    return found[new], merged(ranges)


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, -1 if there is none."""
    n = len(values)
    least = [values]  # least[k][i]: the least of the 2 ** k values that end at i
    while 2 << len(least) <= 2 * n:
        size, before = 1 << len(least) - 1, least[-1]
        least.append(np.concatenate([before[:size], np.minimum(before[size:], before[:-size])]))
    at = np.arange(n) - 1
    for k in reversed(range(len(least))):
        go = np.flatnonzero(at >= (1 << k) - 1)
        go = go[least[k][at[go]] > values[go]]
        at[go] -= 1 << k
    return at


def common_prefix(suffixes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The length of the common prefix of each suffix (row) and another one, 0 where there is none (-1)."""
    out = np.zeros(len(suffixes), np.int64)
    some = np.flatnonzero(other >= 0)
    differ = suffixes[some] != suffixes[other[some]]
    out[some] = np.where(differ.any(axis=1), differ.argmax(axis=1), suffixes.shape[1])
    return out


def longest_previous_factors(suffixes: np.ndarray, position: np.ndarray) -> np.ndarray:
    """The length of the longest match of each suffix that starts earlier, both cut to the width of suffixes.

    In suffix order the longest earlier match of a suffix is with the nearest one before it, or the
    nearest one after it, that has a smaller position.
    """
    array = np.argsort(suffixes.view(f"S{suffixes.shape[1]}").ravel(), kind="stable")
    suffixes, position = suffixes[array], position[array]
    before = previous_smaller(position)
    after = len(array) - 1 - previous_smaller(position[::-1])[::-1]
    after[after == len(array)] = -1
    out = np.empty(len(array), np.int64)
    out[array] = np.maximum(common_prefix(suffixes, before), common_prefix(suffixes, after))
    return out


def earlier_matches(records: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Ranges of the windows of these stretches that have an earlier match among them.

    The stretches' bytes follow each other in data.  Places whose window's hash is there once have no
    match; of the others, the longest previous factors say whether one reaches LENGTH bytes.
    """
    length = records["w"].astype(np.int64) + LENGTH
    base = np.cumsum(length) - length
    order = np.lexsort([records[k] for k in ("lo", "th", "doc")])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    count = records["w"].astype(np.int64) + 1
    owner = np.repeat(np.arange(len(records)), count)
    place = expand(np.zeros(len(records), np.int64), count)
    start = base[owner] + place
    hashes = span_hashes(prefix_sums(data), start, start + LENGTH)
    by = np.argsort(hashes, kind="stable")
    hashes = hashes[by]
    same = np.zeros(len(by) + 1, bool)
    same[1:-1] = hashes[1:] == hashes[:-1]
    twice = same[:-1] | same[1:]
    by, fresh = by[twice], ~same[:-1][twice]
    position = rank[owner] * 256 + place  # a stretch has fewer windows
    hit = np.zeros(len(start), bool)
    edges = np.flatnonzero(fresh)
    at = 0
    while at < len(by):  # lots of whole groups of equal hash
        upto = int(edges[min(np.searchsorted(edges, at + WINDOWS), len(edges) - 1)]) if at + WINDOWS < len(by) else len(by)
        upto = upto if upto > at else len(by)
        some = by[at:upto]
        hit[some] = longest_previous_factors(data[start[some][:, None] + np.arange(LENGTH)], position[some]) >= LENGTH
        at = upto
    found = np.flatnonzero(hit)
    out = np.zeros(len(found), RANGE)
    for k in ("doc", "th"):
        out[k] = records[k][owner[found]]
    out["a"] = records["lo"][owner[found]] + place[found]
    out["b"] = out["a"] + LENGTH
    return merged(out)


def compare(answers: DataFrame, buckets: int) -> DataFrame:
    """Ranges by bucket of their document."""

    def run(key, table):
        kind, blobs = key[0].as_py(), table.column("blob").combine_chunks()
        if kind == RANGES:
            return pa.Table.from_batches([rows_of([(RANGES, key[1].as_py(), b.as_py()) for b in blobs])])
        if kind == SHARED:
            found = first_windows(np.concatenate([np.frombuffer(b.as_buffer(), WINDOW) for b in blobs]))[1]
        else:
            records = np.concatenate([np.frombuffer(b.as_buffer(), ASK) for b in table.column("asks").combine_chunks()])
            data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(b.as_py()) for b in blobs), np.uint8)
            found = earlier_matches(records, data)
        return pa.Table.from_batches([rows_of([(RANGES, b, blob) for b, blob in parts(found, doc_bucket(found["doc"], buckets))])])

    return answers.groupBy("kind", "bucket").applyInArrow(run, SCHEMA)


def cut(ranges: DataFrame, texts: DataFrame, with_text: bool) -> DataFrame:
    def run(left, right):
        known = by_document(merged(np.concatenate([np.frombuffer(b.as_buffer(), RANGE) for b in left.column("blob").combine_chunks()])) if left.num_rows else np.zeros(0, RANGE))
        out = [[] for _ in range(6)]
        for doc, key, th, text in unpacked(right):
            some = known.get((key, th), ())
            digest, at, removed, left_over = hashlib.sha256(), 0, 0, []
            for a, b in zip(some["a"].tolist(), some["b"].tolist()) if len(some) else ():
                digest.update(text[at:a])
                left_over.append(text[at:a])
                removed, at = removed + b - a, b
            digest.update(text[at:])
            left_over.append(text[at:])
            for values, v in zip(out, (doc, len(text), removed, len(some), digest.hexdigest(), b"".join(left_over) if with_text else None)):
                values.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
        return pa.table({n: pa.array(v, k) for n, v, k in list(zip(names, out, kinds))[: 5 + with_text]})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return ranges.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInArrow(run, schema)


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the bytes kept if asked for."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 32 + int(size // BUCKET_BYTES)
    found = written(resolve(find(docs, buckets), buckets), "suffix-found")
    asks = grouped(found, hot_anchors(found), buckets)
    matched = written(compare(answer(asks, packed(docs, buckets), buckets), buckets), "suffix-windows")
    ranges = found.where(F.col("kind") == RANGES).unionByName(matched).select("bucket", "blob")
    return cut(ranges, packed(docs, buckets), with_text)
