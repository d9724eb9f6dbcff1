"""A wavelet matrix of token ids: bit-planes with ranks, in one compressed file.

The file has a directory, then per plane its ranks (ones before every ``RANK_BITS`` bits) as
they are, and its bits in blocks that are compressed one by one. Access and counting
read a rank and a block per plane; occurrences select by a search in the ranks. Only decoding
unpacks everything.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

MAGIC = b"WVM2"
#: Bits between two stored ranks.
RANK_BITS = 512
RANK_BYTES = RANK_BITS // 8
#: Bytes of a plane that are compressed together.
BLOCK_BYTES = 1 << 15


class StoredPlane:
    """A plane inside a file: bytes are unpacked block by block, as they are asked for."""

    def __init__(self, data: memoryview, size: int, blocks: list[int]):
        self.data, self.size, self.ends = data, size, np.cumsum(blocks).tolist()
        self.unpacked: dict[int, np.ndarray] = {}

    def block(self, i: int) -> np.ndarray:
        if i not in self.unpacked:
            packed = self.data[self.ends[i - 1] if i else 0 : self.ends[i]]
            self.unpacked[i] = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
        return self.unpacked[i]

    def __len__(self) -> int:
        return self.size

    def rows(self, starts: np.ndarray) -> np.ndarray:
        """``RANK_BYTES`` bytes from each start on, which are multiples of that; zeros behind the end."""
        found = np.zeros((len(starts), RANK_BYTES), np.uint8)
        for i in np.unique(starts // BLOCK_BYTES).tolist():
            own, block = np.flatnonzero(starts // BLOCK_BYTES == i), self.block(i)
            padded = np.append(block, np.zeros(-len(block) % RANK_BYTES, np.uint8)).reshape(-1, RANK_BYTES)
            found[own] = padded[starts[own] % BLOCK_BYTES // RANK_BYTES]
        return found

    def whole(self) -> np.ndarray:
        return np.concatenate([self.block(i) for i in range(len(self.ends))]) if self.ends else np.zeros(0, np.uint8)


class Plane:
    """A plane in memory."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __len__(self) -> int:
        return len(self.bits)

    def rows(self, starts: np.ndarray) -> np.ndarray:
        padded = np.append(self.bits, np.zeros(-len(self.bits) % RANK_BYTES, np.uint8)).reshape(-1, RANK_BYTES)
        return padded[starts // RANK_BYTES]

    def whole(self) -> np.ndarray:
        return self.bits


def ranks_of(bits: np.ndarray) -> np.ndarray:
    """Ones before every ``RANK_BITS`` bits, and all ones at the end."""
    counts = np.bitwise_count(bits).astype(np.int64)
    sums = np.add.reduceat(counts, np.arange(0, len(counts), RANK_BYTES)) if len(counts) else counts
    return np.concatenate(([0], np.cumsum(sums))).astype("<u4")


class WaveletMatrix:
    """Ids as bit-planes, the highest first; each plane sorts the ids stably by its bit.

    ``zeros[p]`` is the number of zero bits of plane ``p``; an id with a one bit goes
    behind all ids with a zero bit.
    """

    def __init__(self, size: int, planes: list, zeros: list[int], ranks: list[np.ndarray]):
        self.size, self.planes, self.zeros, self.ranks = size, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros = [], []
        for shift in range(bits - 1, -1, -1):
            ones = ids & ids.dtype.type(1 << shift) != 0
            planes.append(np.packbits(ones))
            low = np.flatnonzero(~ones)
            zeros.append(len(low))
            ids = np.concatenate((ids.take(low), ids.take(np.flatnonzero(ones))))
        return cls(len(ids), [Plane(p) for p in planes], zeros, [ranks_of(p) for p in planes])

    def plane(self, p: int) -> np.ndarray:
        return np.unpackbits(self.planes[p].whole(), count=self.size).astype(bool)

    def ones_before(self, p: int, places: np.ndarray) -> np.ndarray:
        """Ones of plane ``p`` before each place: a stored rank and a count inside one row of bits."""
        places = np.asarray(places, np.int64)
        row, rest = places // RANK_BITS, places % RANK_BITS
        found = self.ranks[p][row].astype(np.int64)
        inside = np.flatnonzero(rest)
        bits = np.unpackbits(self.planes[p].rows(row[inside] * RANK_BYTES), axis=1)
        found[inside] += (bits & (np.arange(RANK_BITS) < rest[inside, None])).sum(1, dtype=np.int64)
        return found

    def select(self, p: int, bit: int, numbers: np.ndarray) -> np.ndarray:
        """Place of each so many-th bit of a kind (from 0) in plane ``p``: a search in the ranks, then inside one row."""
        ranks = self.ranks[p].astype(np.int64)
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * RANK_BITS, self.size) - ranks
        row = np.searchsorted(before, numbers, "right") - 1
        bits = np.unpackbits(self.planes[p].rows(row * RANK_BYTES), axis=1) == bit
        return row * RANK_BITS + (np.cumsum(bits, 1) == (numbers - before[row] + 1)[:, None]).argmax(1)

    def decode(self) -> np.ndarray:
        """All ids in order, from the lowest plane to the highest, each undoing one stable sort."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        ids = np.zeros(self.size, kind)
        for p in range(len(self.planes) - 1, -1, -1):
            ones, zeros = self.plane(p), self.zeros[p]
            ids[zeros:] |= kind(1 << (len(self.planes) - 1 - p))
            before = np.empty_like(ids)
            before[np.flatnonzero(~ones)] = ids[:zeros]
            before[np.flatnonzero(ones)] = ids[zeros:]
            ids = before
        return ids

    def access(self, place: int) -> int:
        """The id at a place."""
        value = 0
        for p in range(len(self.planes)):
            ones, next_ones = self.ones_before(p, np.array([place, place + 1])).tolist()
            bit = next_ones - ones
            value = value << 1 | int(bit)
            place = self.zeros[p] + ones if bit else place - ones
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for p in range(len(self.planes)):
            ones = self.ones_before(p, np.array([start, end]))
            if token >> (len(self.planes) - 1 - p) & 1:
                start, end = self.zeros[p] + int(ones[0]), self.zeros[p] + int(ones[1])
            else:
                start, end = start - int(ones[0]), end - int(ones[1])
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often a token stands in a range."""
        if token >> len(self.planes):
            return 0
        first, last = self._range(token, start, self.size if end is None else end)
        return last - first

    def occurrences(self, token: int) -> np.ndarray:
        """All places of a token, ascending: its range in the last order, traced back up (select)."""
        if token >> len(self.planes):
            return np.zeros(0, np.int64)
        first, last = self._range(token, 0, self.size)
        places = np.arange(first, last)
        few = len(places) * RANK_BITS < self.size  # else all bits of a plane at once are cheaper
        for p in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - p) & 1
            numbers = places - bit * self.zeros[p]
            places = self.select(p, bit, numbers) if few else np.flatnonzero(self.plane(p) == bool(bit))[numbers]
        return places

    def to_bytes(self) -> bytes:
        """Magic, length of the directory, directory (JSON), then per plane its ranks and its compressed blocks."""
        packer = zstandard.ZstdCompressor(level=1)
        parts, blocks = [], []
        for plane, ranks in zip(self.planes, self.ranks, strict=True):
            bits = plane.whole().tobytes()
            packed = [packer.compress(bits[i : i + BLOCK_BYTES]) for i in range(0, len(bits), BLOCK_BYTES)]
            blocks.append([len(x) for x in packed])
            parts += [ranks.tobytes(), *packed]
        header = json.dumps({"size": self.size, "zeros": self.zeros, "blocks": blocks}).encode()
        return b"".join([MAGIC, struct.pack("<I", len(header)), header, *parts])

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        """The matrix of a file; nothing is unpacked yet."""
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (length,) = struct.unpack("<I", data[4:8])
        header, at, view = json.loads(data[8 : 8 + length]), 8 + length, memoryview(data)
        n_bytes = (header["size"] + 7) // 8
        n_ranks = (n_bytes + RANK_BYTES - 1) // RANK_BYTES + 1
        planes, ranks = [], []
        for blocks in header["blocks"]:
            ranks.append(np.frombuffer(data, "<u4", n_ranks, at))
            at += 4 * n_ranks
            planes.append(StoredPlane(view[at : at + sum(blocks)], n_bytes, blocks))
            at += sum(blocks)
        return cls(header["size"], planes, header["zeros"], ranks)
