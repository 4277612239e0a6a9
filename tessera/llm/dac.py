"""Directly addressable codes: integers in chunk levels with rank directories.

An integer's lowest chunk of ``width`` bits stands at level 0, in the order of
the integers. A continuation bit beside each chunk says whether a further chunk
follows at the next level; its place there is the number of set bits before it.
A directory of counts every ``BLOCK`` bits answers that rank, so any integer is
read with one step a level and nothing else is decoded.

Layout, little-endian: ``DAC1``, n (u64), levels (u8), width (u8), then for each
level its length (u64), its chunks (u8 each), its bitmap (lowest bit first) and
its directory (u64 each).
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
BLOCK = 512
WIDTH = 8
_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def encode(values: np.ndarray) -> bytes:
    """The code of non-negative integers under 2**32."""
    rest = np.asarray(values, dtype=np.uint32)
    levels = []
    while True:
        chunks, more = rest.astype(np.uint8), rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(_POP[bitmap], np.arange(0, len(bitmap), BLOCK // 8), dtype=np.uint64) if len(bitmap) else np.zeros(0, np.uint64)
        directory = np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)])[: len(counts)]
        levels.append(struct.pack("<Q", len(rest)) + chunks.tobytes() + bitmap.tobytes() + directory.astype("<u8").tobytes())
        rest = rest[more] >> WIDTH
        if not len(rest):
            break
    return MAGIC + struct.pack("<QBB", len(values), len(levels), WIDTH) + b"".join(levels)


class Dac:
    """A reader over the bytes of one code."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a directly addressable code")
        self.n, n_levels, width = struct.unpack_from("<QBB", data, 4)
        if width != WIDTH:
            raise ValueError(f"chunk width {width}")
        self.levels, at = [], 14
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            n_bitmap = (n + 7) // 8
            n_dir = (n_bitmap + BLOCK // 8 - 1) // (BLOCK // 8)
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            bitmap = np.frombuffer(data, np.uint8, n_bitmap, at + n)
            directory = np.frombuffer(data, "<u8", n_dir, at + n + n_bitmap)
            self.levels.append((chunks, bitmap, directory))
            at += n + n_bitmap + 8 * n_dir

    def __len__(self) -> int:
        return self.n

    @staticmethod
    def _rank(bitmap: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Set bits before position ``i``."""
        byte, block = i // 8, i // BLOCK
        first = block * (BLOCK // 8)
        before = int(directory[block]) if block < len(directory) else 0
        if block >= len(directory) and len(directory):
            before, first = int(directory[-1]), (len(directory) - 1) * (BLOCK // 8)
        before += int(_POP[bitmap[first:byte]].sum())
        return before + int(_POP[bitmap[byte] & ((1 << (i % 8)) - 1)] if i % 8 else 0)

    def __getitem__(self, i: int) -> int:
        """The ``i``-th integer, by one rank a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << (WIDTH * level)
            if not bitmap[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(bitmap, directory, i)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Integers ``start`` to ``stop``: one rank a level, then the level's own run of chunks."""
        out = np.zeros(max(0, stop - start), dtype=np.uint32)
        where = np.arange(len(out))
        for level, (chunks, bitmap, directory) in enumerate(self.levels):
            if start >= stop:
                break
            out[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(WIDTH * level)
            first = start // 8
            bits = np.unpackbits(bitmap[first : (stop + 7) // 8], bitorder="little")[start - 8 * first : stop - 8 * first].astype(bool)
            where = where[bits]
            start = self._rank(bitmap, directory, start)
            stop = start + len(where)
        return out
