"""Vectorised word and n-gram hashing over Arrow text columns.

All functions work on the UTF-8 bytes of a chunk of documents, about a megabyte at a time, so memory is bounded by the
longest single document. Word hashes are 64-bit polynomial hashes over a fixed random byte table, finalised with a
multiply-xor mix; equality of two 64-bit hashes is taken as equality of words only where the caller says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: One less than a power of two, as tables of powers are made for one more byte than a chunk has.
CHUNK_BYTES = (1 << 20) - 1

U = np.uint64
_MASK = (1 << 64) - 1
_BASE, _GRAM = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)

#: Words of `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: A-Z to a-z, all else kept.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class _Powers:
    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, U), np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, factor in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                x = np.full(size, factor, U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _GRAM_POWERS = _Powers(_BASE), _Powers(_GRAM)


@dataclass
class Words:
    """Words of a chunk of documents: byte spans in `data`, and for document d the words first[d]:first[d + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        up, down = _BYTE_POWERS.get(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, U)
        np.cumsum(_VALUES[self.data] * up[:-1], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most `limit` bytes, or one longer row. Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def split_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, fold: np.ndarray | None = None) -> Words:
    data = data if fold is None else fold[data]
    inside = ~separators[data]
    starts, ends = inside.copy(), inside.copy()
    if len(data):
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        starts[inner] = inside[inner]
        ends[inner - 1] = inside[inner - 1]
    begin = np.flatnonzero(starts)
    return Words(data, begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, offsets))


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words within one document, and the position of each one's first word."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    up, down = _GRAM_POWERS.get(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + k <= last)
    return mix((sums[at + k] - sums[at]) * down[at] + U(k)), at


def whole(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each document's whole word sequence."""
    up, down = _GRAM_POWERS.get(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    return mix((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]] + np.diff(first).astype(U))


def bounds(values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values in a sorted array, and its length at the end."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]).astype(np.int64) if len(values) else np.zeros(1, np.int64)
