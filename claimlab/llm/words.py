"""Words of whole texts as 64-bit hashes, computed for many texts at once on the bytes of an Arrow column.

A word is a longest run of bytes other than space and the control characters 9 to 13, which is also what
`bytes.split()` gives. Its hash is a polynomial over its bytes modulo 2**64, taken from running sums of the
whole block, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes hashed in one go; several arrays of eight bytes for each of these live at a time.
BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_IS_PLAIN = _IS_WORD.copy()
_IS_PLAIN[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = False
_PLUS_ONE = np.arange(1, 257, dtype=np.uint64)
_LOWERED = _PLUS_ONE.copy()
_LOWERED[65:91] = _PLUS_ONE[97:123]

_powers: dict[str, np.ndarray] = {}


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit values."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(kind: str, size: int) -> np.ndarray:
    held = _powers.get(kind)
    if held is None or len(held) < size:
        size = max(size, BLOCK_BYTES + 1)
        held = np.full(size, _BASE if kind == "up" else _INVERSE, dtype=np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if size <= 4 * BLOCK_BYTES:
            _powers[kind] = held
    return held[:size]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text begins and ends in them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    content = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return content, bounds


def word_hashes(texts: pa.Array, lower: bool = False, plain: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For blocks of whole texts: index of the first text, hash of each word, and where each text's words begin.

    `plain` takes ASCII punctuation as space too. The last array has one more entry than texts, so text `first + i` has words `begin[i]` to `begin[i + 1]`.
    """
    content, bounds = text_bytes(texts)
    first, count = 0, len(bounds) - 1
    while first < count:
        last = int(np.searchsorted(bounds, bounds[first] + BLOCK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), count)
        block = content[bounds[first] : bounds[last]]
        yield first, *_block_hashes(block, bounds[first : last + 1] - bounds[first], lower, _IS_PLAIN if plain else _IS_WORD)
        first = last


def _block_hashes(block: np.ndarray, bounds: np.ndarray, lower: bool, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = len(block)
    if size == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = is_word[block]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = bounds[bounds < size]
    begins[edges] = inside[edges]
    edges = bounds[bounds > 0] - 1
    ends[edges] = inside[edges]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(size + 1, dtype=np.uint64)
    codes = (_LOWERED if lower else _PLUS_ONE)[block]
    codes *= _power("up", size)[:size]
    np.cumsum(codes, out=sums[1:])
    hashes = (sums[ends] - sums[begins]) * _power("down", size)[begins]
    return mixed(hashes), np.searchsorted(begins, bounds)
