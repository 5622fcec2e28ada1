"""Directly addressable codes: a byte layout for token ids from which any id is read without decoding its neighbours."""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
#: Bits of an id that a level holds, and bits of a bitmap that an entry of its rank directory covers.
CHUNK, BLOCK = 8, 512
_HEAD = struct.Struct("<4sBQ")
_LEVEL = struct.Struct("<QQQ")


def encode(ids: np.ndarray) -> bytes:
    """The file of a sequence of ids (unsigned 32-bit).

    Level 0 holds the low 8 bits of every id and a bitmap that says which ids go on; level 1 the next 8 bits of those,
    and so on. A rank directory for each bitmap has the set bits before each block of 512, so that an id's place in the
    next level is a lookup and the count of at most 512 bits.
    """
    rest, levels = np.asarray(ids, dtype=np.uint32), []
    while True:
        chunk, rest = (rest & 0xFF).astype(np.uint8), rest >> CHUNK
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(more) // BLOCK) * BLOCK, dtype=np.uint32)
        padded[: len(more)] = more
        ranks = np.concatenate([[0], np.cumsum(padded.reshape(-1, BLOCK).sum(1))]).astype("<u8")
        levels.append((chunk.tobytes(), bits.tobytes(), ranks.tobytes()))
        rest = rest[more]
        if not len(rest):
            break
    head = _HEAD.pack(MAGIC, len(levels), len(ids))
    return b"".join([head, *(_LEVEL.pack(*map(len, x)) for x in levels), *(part for x in levels for part in x)])


class Reader:
    """Random access to an encoded sequence: get(i) for one id, slice(a, b) for neighbouring ones."""

    def __init__(self, raw: bytes) -> None:
        magic, depth, self.n = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        at, self.levels = _HEAD.size + depth * _LEVEL.size, []
        for k in range(depth):
            parts = []
            for size, kind in zip(_LEVEL.unpack_from(raw, _HEAD.size + k * _LEVEL.size), (np.uint8, np.uint8, "<u8"), strict=True):
                parts.append(np.frombuffer(raw, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
                at += size
            self.levels.append(parts)

    def __len__(self) -> int:
        return self.n

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before bit i."""
        start = i // BLOCK * (BLOCK // 8)
        n = int(ranks[i // BLOCK]) + int(np.bitwise_count(bits[start : i // 8]).sum())
        return n + (int(bits[i // 8]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else n

    def get(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << (CHUNK * k)
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(bits, ranks, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1; of each level only the part that belongs to them is read."""
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b))
        out, at = np.zeros(b - a, dtype=np.uint32), np.arange(b - a)
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            if a == b:
                break
            out[at] |= chunk[a:b].astype(np.uint32) << np.uint32(CHUNK * k)
            more = np.unpackbits(bits[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            at = at[more]
            a = self._rank(bits, ranks, a)
            b = a + len(at)
        return out
