"""Elias-Fano code for non-decreasing integer sequences.

``n`` values below ``u`` take about ``2 + log2(u / n)`` bits each: the low
bits are stored plainly, the high bits as a unary bitmap in which value ``i``
sets bit ``(x_i >> low) + i``. ``select`` finds a set bit through a directory
that holds the bit position of every 512th one (32-bit entries), so single values are
read without decoding the sequence.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = "<QBII"  # values, low bits, bytes of low part, bytes of high part
_STEP = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def encode(values: np.ndarray) -> bytes:
    """Encode non-decreasing, non-negative integers."""
    x = np.asarray(values, dtype=np.uint64)
    n = len(x)
    if n == 0:
        return struct.pack(_HEAD, 0, 0, 0, 0)
    if n > 1 and bool(np.any(x[1:] < x[:-1])):
        raise ValueError("values must not decrease")
    low = max(0, (int(x[-1]) // n).bit_length() - 1)
    high = (x >> np.uint64(low)) + np.arange(n, dtype=np.uint64)
    bitmap = np.zeros(int(high[-1]) + 1, dtype=np.uint8)
    bitmap[high] = 1
    upper = np.packbits(bitmap, bitorder="little").tobytes()
    if low:
        shifts = np.arange(low, dtype=np.uint64)
        lower = np.packbits(((x[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
    else:
        lower = b""
    directory = high[::_STEP].astype("<u4").tobytes()
    return struct.pack(_HEAD, n, low, len(lower), len(upper)) + lower + upper + directory


class EliasFano:
    """Reader over the bytes that ``encode`` made."""

    def __init__(self, data: bytes) -> None:
        self.n, self.low, n_lower, n_upper = struct.unpack_from(_HEAD, data)
        at = struct.calcsize(_HEAD)
        self._lower = np.frombuffer(data, np.uint8, n_lower, at)
        self._upper = np.frombuffer(data, np.uint8, n_upper, at + n_lower)
        entries = -(-self.n // _STEP)
        self._directory = np.frombuffer(data, "<u4", entries, at + n_lower + n_upper)

    def __len__(self) -> int:
        return self.n

    def _low_bits(self, i: int) -> int:
        if not self.low:
            return 0
        first, last = i * self.low, (i + 1) * self.low
        chunk = int.from_bytes(self._lower[first >> 3:(last + 7) >> 3].tobytes(), "little")
        return (chunk >> (first & 7)) & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """Value ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self._directory[i // _STEP])
        want = i % _STEP + int(_ONES[int(self._upper[at >> 3]) & ((1 << (at & 7)) - 1)])
        byte = at >> 3  # the wanted one is number ``want`` (from 0) from this byte on
        while True:
            counts = np.cumsum(_ONES[self._upper[byte:byte + 256]], dtype=np.int64)
            if counts[-1] > want:
                break
            want -= int(counts[-1])
            byte += 256
        k = int(np.searchsorted(counts, want, side="right"))
        want -= int(counts[k - 1]) if k else 0
        bits = np.unpackbits(self._upper[byte + k:byte + k + 1], bitorder="little")
        high = (byte + k) * 8 + int(np.flatnonzero(bits)[want])
        return ((high - i) << self.low) | self._low_bits(i)

    def decode(self) -> np.ndarray:
        """All values as uint64."""
        if not self.n:
            return np.zeros(0, np.uint64)
        ones = np.flatnonzero(np.unpackbits(self._upper, bitorder="little"))[:self.n]
        x = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            bits = np.unpackbits(self._lower, bitorder="little")[:self.n * self.low].reshape(self.n, self.low)
            x |= (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return x
