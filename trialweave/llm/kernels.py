"""Array kernels over the UTF-8 bytes of Arrow string columns.

Word classes that are stated by code point ranges below U+0080 can be read off single bytes, since
every byte of a longer UTF-8 sequence is 0x80 or above. Texts are handled in slices of about
``SLICE_BYTES``, so the arrays of a task stay small whatever the batch holds; a longer text is a slice
of its own. Hashes are 64-bit polynomial prefix sums over random byte values, finished by a mixer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_SEED = 20240229
_BASE, _GRAM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM_INV = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))

BYTE_VALUES = np.random.default_rng(_SEED).integers(1, _MASK, 256, dtype=np.uint64, endpoint=True)
#: The same value for a letter A-Z and its lower case.
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]

#: ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Everything but space and the control characters 9 to 13.
NONSPACE = np.ones(256, bool)
NONSPACE[32] = NONSPACE[9:14] = False


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finisher (shift-multiply)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self, base: np.uint64):
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            grown = np.full(max(n, 1 << 16), self.base, np.uint64)
            grown[0] = 1
            self.values = np.cumprod(grown, dtype=np.uint64)
        return self.values[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_BASE_INV)
_GRAM_UP, _GRAM_DOWN = _Powers(_GRAM), _Powers(_GRAM_INV)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return raw, at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes, or of one text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1, first + 1)
        yield first, min(last, n)
        first = min(last, n)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` bytes: starts, ends, and the number of words before each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    is_word = inside[data]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = is_word[edge]
    last[edge - 1] = is_word[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, the same wherever the span stands."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _UP.upto(len(data)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _DOWN.upto(len(data) + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64))


def gram_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; positions run over all texts, so callers mask borders."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(word_hashes) + 1, np.uint64)
    np.cumsum(word_hashes * _GRAM_UP.upto(len(word_hashes)), out=sums[1:])
    return mix((sums[k:] - sums[:n]) * _GRAM_DOWN.upto(n) + np.uint64(k))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first text, last text, bytes, offsets) for slices of a column."""
    data, offsets = utf8(column)
    for i, j in slices(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
