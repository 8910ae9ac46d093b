"""Texts of an Arrow batch as numpy arrays: bytes, words, rolling hashes. Used inside Spark tasks only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# fixed values: the separators of words are space and U+0009 to U+000D
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# A-Z to a-z, every other byte as it is
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept by the worker process."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16) * 5 // 4
        for k, base in enumerate((BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``ranges`` turns them into hashes of any range."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, powers(len(values))[0], out=out[1:], casting="unsafe")
    np.cumsum(out[1:], out=out[1:])
    return out


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values in each [start, end); equal ranges have equal hashes."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def windows(sums: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each place on."""
    count = len(sums) - n
    if count <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[n:] - sums[:count]) * powers(len(sums))[1][:count])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the offsets of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` bytes; a longer text is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


class Words:
    """Words of some texts: byte ranges in ``data`` and, per text, the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        inside = ~separator[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)  # number of the first word of each text
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        sums = prefix_hash(self.data + np.uint64(1))
        return ranges(sums, self.start, self.end)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words with one space after each, and where each begins and ends there."""
        size = self.end - self.start
        begin = np.cumsum(size + 1) - (size + 1)
        flat = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flat[np.repeat(begin, size) + within] = self.data[np.repeat(self.start, size) + within]
        return flat, begin, begin + size

    def of_text(self) -> np.ndarray:
        """Number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.count)), self.count)


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values in each range [first[i], first[i+1])."""
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=run[1:])
    return run[first[1:]] - run[first[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys
