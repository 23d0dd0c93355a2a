"""Elias-Fano code of a non-decreasing sequence, with a select directory.

Of n values below u each keeps its lowest ``floor(log2(u / n))`` bits as they are; the rest
goes to a unary bit vector.  Together that is about ``2 + log2(u / n)`` bits a value.  The
directory holds the place of every 64th set bit, so that select() looks at a few words only.
"""

from __future__ import annotations

import numpy as np

STEP = 64


def encode(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """(number of low bits, low bits, high bits, directory)."""
    n = len(values)
    if not n:
        return 0, b"", b"", b""
    values = values.astype(np.uint64)
    bits = max(0, int(int(values[-1]) // n).bit_length() - 1)
    low = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1, np.uint8)
    high[ones] = 1
    pack = lambda x: np.packbits(x.astype(np.uint8).ravel(), bitorder="little").tobytes()
    return bits, pack(low), pack(high), ones[::STEP].astype("<u4").tobytes()


class EliasFano:
    def __init__(self, n: int, bits: int, low: bytes, high: bytes, directory: bytes):
        self.n, self.bits = n, bits
        self.low = np.frombuffer(low, np.uint8)
        self.high = np.frombuffer(high, np.uint8)
        self.directory = np.frombuffer(directory, "<u4")

    def _low(self, first: int, end: int) -> np.ndarray:
        at = np.arange(first * self.bits, end * self.bits)
        bit = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bit.reshape(end - first, self.bits).astype(np.int64) << np.arange(self.bits)).sum(axis=1)

    def select(self, i: int) -> int:
        """The value at place i."""
        return int(self.select_many(i, i + 1)[0])

    def select_many(self, first: int, end: int) -> np.ndarray:
        """The values at places first to end: of the unary bits, no more are read than the directory says they need."""
        if first >= end:
            return np.zeros(0, np.int64)
        lead = int(self.directory[first // STEP])
        tail = int(self.directory[-(-end // STEP)]) if -(-end // STEP) < len(self.directory) else 8 * len(self.high)
        byte = lead >> 3
        ones = np.flatnonzero(np.unpackbits(self.high[byte : (tail >> 3) + 1], bitorder="little")) + 8 * byte
        ones = ones[ones >= lead][first % STEP :][: end - first]
        return (ones - np.arange(first, end) << self.bits) + self._low(first, end)

    def all(self) -> np.ndarray:
        return self.select_many(0, self.n)
