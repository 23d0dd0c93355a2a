"""NumPy kernels over whole Arrow string columns, without a Python object per value.

Every kernel works on (data, bounds): the UTF-8 bytes of consecutive texts and the offsets
between them.  Batches are cut to bounded pieces, so that temporaries stay small whatever
the length of the texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column as large_binary with null as empty."""
    texts = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(texts.cast(pa.large_binary()), b"")


def pieces(texts: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, bounds) of consecutive rows of about ``size`` bytes; a longer text stands alone."""
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ..., n - 1 modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, np.uint64(base), np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size > 8 * PIECE_BYTES:  # of one very long text: not kept
            return have[:n]
        _powers[base] = have
    return have[:n]


#: What a worker keeps between tasks and can make again.
kept: list[dict] = [_powers]


def give_back(kept_too: bool = False) -> None:
    """Hand freed memory back to the system: Python workers outlive the stages that filled them.

    kept_too: first drop what other stages left in the worker, such as encoders.
    """
    if kept_too:
        for cache in kept:
            cache.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in the bytes, from which span_hashes() reads any span."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end), alike for equal bytes at any place."""
    n = len(sums)
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))


#: Offsets in a word whose terms are looked up; those of longer words are worked out.
_NEAR = 32


def _terms(offset: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A 64-bit number for each byte at its place in its word, without algebra between places."""
    return mix(mix(offset.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) ^ (data.astype(np.uint64) + np.uint64(1)))


_TABLE = _terms(np.repeat(np.arange(_NEAR), 256), np.tile(np.arange(256), _NEAR))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words [start, end), which are in order and apart.

    The numbers of a word's bytes at their places are summed.  Unlike a polynomial in one base modulo
    a power of two, of which different words such as Thue-Morse words are zeros together, the numbers
    of different places have no common factors.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    at = expand(starts, length)
    first = np.cumsum(length) - length
    offset = np.arange(len(at)) - np.repeat(first, length)
    seen = data[at]
    near = np.minimum(offset, _NEAR - 1) * 256 + seen
    terms = _TABLE[near]
    far = np.flatnonzero(offset >= _NEAR)
    if len(far):
        terms[far] = _terms(offset[far], seen[far])
    return mix(np.add.reduceat(terms, first) + length.astype(np.uint64))


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ..., start + length - 1 of every span, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def word_spans(data: np.ndarray, bounds: np.ndarray, apart: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the bounds of each row's words among them; apart: the bytes between words, ``[\\x20\\x09-\\x0D]``."""
    inside = ~apart[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = bounds[1:-1]
    before[edges[edges < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = edges[edges > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each element between the bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def with_ends(ids: np.ndarray, bounds: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ids with an end id after each row, and their bounds."""
    rows = np.arange(len(bounds))
    out = np.full(len(ids) + len(bounds) - 1, end, ids.dtype)
    out[np.arange(len(ids)) + row_of(bounds)] = ids
    return out, bounds + rows
