"""Token output as wavelet matrices: one compressed file of succinct bit-planes per shard.

File format (all integers little-endian):
    magic QWM1; u32 length and JSON header; blocks; u64 offset of the header's end is not needed as the header is first.
The header holds n (tokens), width (planes), zeros (zeros of each plane), block (bits in a block), documents (ids or
null), lengths, first and last id, and for every plane the byte offset, stored size and rank before each block. A block is
`block` bits of one plane, packed, as zstd or raw where that is smaller. A reader opens the header and only the blocks
on its path: access, rank, count and select read one or two blocks of each plane.
"""

from __future__ import annotations

import json
import zlib
from collections import OrderedDict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard

MAGIC, BLOCK = b"QWM1", 1 << 17


def planes(tokens: np.ndarray, width: int) -> tuple[list[np.ndarray], list[int]]:
    """Bit-planes from the highest bit, each in the order that the planes above have sorted the tokens into."""
    x, bits, zeros = tokens, [], []
    for k in range(width - 1, -1, -1):
        one = (x & np.asarray(1 << k, x.dtype)).astype(bool)
        bits.append(one)
        low = np.flatnonzero(~one)  # taking by position is several times as fast as by mask where bits look random
        zeros.append(len(low))
        x = np.concatenate([x[low], x[np.flatnonzero(one)]])
    return bits, zeros


def restore(bits: Sequence[np.ndarray], zeros: Sequence[int]) -> np.ndarray:
    """The tokens, by undoing the stable partitions from the lowest plane."""
    kind = np.uint16 if len(bits) <= 16 else np.uint32
    x = np.zeros(len(bits[0]) if bits else 0, kind)
    for level, (one, z) in enumerate(zip(reversed(bits), reversed(zeros), strict=True)):
        y = np.empty_like(x)
        y[np.flatnonzero(~one)] = x[:z]
        y[np.flatnonzero(one)] = x[z:] | kind(1 << level)
        x = y
    return x


def encode(tokens: np.ndarray, documents: Sequence[int | None], lengths: Sequence[int]) -> bytes:
    tokens = tokens.astype(np.uint16 if not len(tokens) or tokens.max() < 1 << 16 else np.uint32)
    width = max(1, int(tokens.max()).bit_length() if len(tokens) else 1)
    bits, zeros = planes(tokens, width)
    press, body, index, at = zstandard.ZstdCompressor(level=1), [], [], 0
    for one in bits:
        offsets, sizes, ranks, rank = [], [], [], 0
        for low in range(0, len(one), BLOCK):
            part = one[low : low + BLOCK]
            raw = np.packbits(part).tobytes()
            small = press.compress(raw)
            raw = small if len(small) < len(raw) else raw
            offsets.append(at)
            sizes.append(len(raw))
            ranks.append(rank)
            rank += int(part.sum())
            at += len(raw)
            body.append(raw)
        index.append({"offset": offsets, "size": sizes, "rank": ranks})
    header = json.dumps({"n": len(tokens), "width": width, "zeros": zeros, "block": BLOCK, "documents": list(documents), "lengths": list(lengths), "planes": index}).encode()
    header = zstandard.ZstdCompressor(level=3).compress(header)
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *body])


class WaveletFile:
    """Random access to one shard file: `read(offset, size)` fetches bytes, decoded blocks are kept up to `keep`."""

    def __init__(self, read, keep: int = 64):
        self.read, self.keep = read, keep
        head = read(0, 8)
        if head[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = int.from_bytes(head[4:8], "little")
        self.base = 8 + size
        h = json.loads(zstandard.ZstdDecompressor().decompress(read(8, size)))
        self.n, self.width, self.zeros, self.block = h["n"], h["width"], h["zeros"], h["block"]
        self.documents, self.lengths, self.index = h["documents"], h["lengths"], h["planes"]
        self.blocks: OrderedDict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = OrderedDict()

    @classmethod
    def open(cls, path: str) -> WaveletFile:
        fs, name = pafs.FileSystem.from_uri(path)
        file = fs.open_input_file(name)

        def read(offset: int, size: int) -> bytes:
            file.seek(offset)
            return file.read(size)

        return cls(read)

    def _bits(self, plane: int, b: int) -> np.ndarray:
        p = self.index[plane]
        raw = self.read(self.base + p["offset"][b], p["size"][b])
        n = min(self.block, self.n - b * self.block)
        if len(raw) < (n + 7) // 8:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).view(bool)

    def _block(self, plane: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (plane, b) not in self.blocks:
            bits = self._bits(plane, b)
            self.blocks[plane, b] = bits, np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
            if len(self.blocks) > self.keep:
                self.blocks.popitem(last=False)
        return self.blocks[plane, b]

    def rank1(self, plane: int, i: int) -> int:
        """Ones before position i of a plane."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        b, r = divmod(i, self.block)
        return self.index[plane]["rank"][b] + int(self._block(plane, b)[1][r])

    def select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        ranks = self.index[plane]["rank"]
        before = [r if bit else b * self.block - r for b, r in enumerate(ranks)]
        b = int(np.searchsorted(before, k, "right")) - 1
        bits, ones = self._block(plane, b)
        counts = ones if bit else np.arange(len(ones)) - ones
        return b * self.block + int(np.searchsorted(counts, k - before[b], "right")) - 1

    def access(self, i: int) -> int:
        """Token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(self.width):
            b, r = divmod(i, self.block)
            bit, ones = bool(self._block(p, b)[0][r]), self.rank1(p, i)
            out = out << 1 | bit
            i = self.zeros[p] + ones if bit else i - ones
        return out

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        for p in range(self.width):
            a, b = self.rank1(p, low), self.rank1(p, high)
            low, high = (self.zeros[p] + a, self.zeros[p] + b) if token >> (self.width - 1 - p) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of a token in positions low to high."""
        if token >> self.width:
            return 0
        a, b = self._range(token, low, self.n if high is None else high)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token; -1 if there are fewer."""
        if token >> self.width:
            return -1
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            return -1
        i = a + k
        for p in range(self.width - 1, -1, -1):
            i = self.select(p, 1, i - self.zeros[p]) if token >> (self.width - 1 - p) & 1 else self.select(p, 0, i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens of the shard."""
        bits = [np.concatenate([np.zeros(0, bool), *(self._bits(p, b) for b in range(len(self.index[p]["offset"])))]) for p in range(self.width)]
        return restore(bits, self.zeros)
