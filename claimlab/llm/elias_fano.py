"""Elias-Fano coding of a non-decreasing integer sequence, with select through sampled positions.

Each value is split into `low_bits` low bits, packed one after the other, and a high part, kept as a bit vector
in which value `i` sets bit `high + i`. The position of every `SAMPLE`-th set bit is stored in 32 bits, so
select reads a sample and counts on from there. A sequence of n values up to u takes about
n * (2 + log2(u / n)) bits, whatever the size of its values.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QqQBQQ")  # values, smallest value, range, low bits, low bytes, high bytes


def encode(values: np.ndarray) -> bytes:
    values = np.asarray(values, dtype=np.int64)
    count = len(values)
    if count == 0:
        return _HEAD.pack(0, 0, 0, 0, 0, 0)
    if (np.diff(values) < 0).any():
        raise ValueError("the values must not decrease")
    base = int(values[0])
    shifted = values.astype(np.uint64) - np.uint64(base & 0xFFFFFFFFFFFFFFFF)
    span = int(shifted[-1])
    low_bits = max(0, (span // count).bit_length() - 1)
    low = b""
    if low_bits:
        planes = (shifted[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()
    positions = (shifted >> np.uint64(low_bits)).astype(np.int64) + np.arange(count)
    bits = np.zeros(int(positions[-1]) + 1, dtype=np.uint8)
    bits[positions] = 1
    high = np.packbits(bits, bitorder="little").tobytes()
    samples = positions[::SAMPLE].astype("<u4").tobytes()
    return _HEAD.pack(count, base, span, low_bits, len(low), len(high)) + low + high + samples


class EliasFano:
    """Reads an encoded sequence where it lies in a buffer."""

    def __init__(self, data: bytes | memoryview):
        data = memoryview(data)
        self.count, self.base, self.span, self.low_bits, low_size, high_size = _HEAD.unpack_from(data)
        at = _HEAD.size
        self._low = np.frombuffer(data[at : at + low_size], dtype=np.uint8)
        at += low_size
        self._high = np.frombuffer(data[at : at + high_size], dtype=np.uint8)
        at += high_size
        sampled = -(-self.count // SAMPLE)
        self._samples = np.frombuffer(data[at : at + 4 * sampled], dtype="<u4")
        self.size = at + 4 * sampled

    def __len__(self) -> int:
        return self.count

    def select(self, index: int) -> int:
        """Value `index`, reading the bits between one sample and the next only."""
        if not 0 <= index < self.count:
            raise IndexError(index)
        block = index // SAMPLE
        start = int(self._samples[block])
        stop = int(self._samples[block + 1]) if block + 1 < len(self._samples) else 8 * len(self._high)
        window = np.unpackbits(self._high[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :]
        position = start + int(np.flatnonzero(window)[index % SAMPLE])
        low = 0
        if self.low_bits:
            first = index * self.low_bits
            window = self._low[first // 8 : -(-(first + self.low_bits) // 8)].tobytes()
            low = (int.from_bytes(window, "little") >> (first % 8)) & ((1 << self.low_bits) - 1)
        return self.base + ((position - index) << self.low_bits | low)

    def part(self, first: int, stop: int) -> np.ndarray:
        """Values `first` to `stop` (not included), reading the bits between the samples around them only."""
        first, stop = max(0, first), min(stop, self.count)
        if first >= stop:
            return np.zeros(0, dtype=np.int64)
        block, after = first // SAMPLE, -(-stop // SAMPLE)
        start = int(self._samples[block])
        end = int(self._samples[after]) if after < len(self._samples) else 8 * len(self._high)
        window = np.unpackbits(self._high[start // 8 : -(-end // 8)], bitorder="little")[start % 8 :]
        bits = start + np.flatnonzero(window)[first - block * SAMPLE : stop - block * SAMPLE]
        values = (bits - np.arange(first, stop)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            begin = first * self.low_bits
            packed = self._low[begin // 8 : -(-stop * self.low_bits // 8)]
            planes = np.unpackbits(packed, bitorder="little")[begin % 8 :][: (stop - first) * self.low_bits]
            weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
            values |= (planes.reshape(-1, self.low_bits).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
        return (values + np.uint64(self.base & 0xFFFFFFFFFFFFFFFF)).astype(np.int64)

    def values(self) -> np.ndarray:
        """All values at once."""
        return self.part(0, self.count)
