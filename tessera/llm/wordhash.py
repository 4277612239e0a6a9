"""Word and window hashes of many texts at once, with numpy over their bytes.

A text's words are runs of bytes other than the space and 0x09 to 0x0D. A word's
hash is a polynomial over a random 64-bit value for each byte, modulo 2**64, with
an odd base, so that it comes from two prefix sums; a mixing step follows. Windows
of words are hashed the same way over the words' hashes. ``seed`` picks the byte
values, so two seeds give 128 independent bits.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np

U = np.uint64

try:
    _LIBC = ctypes.CDLL(None)
except OSError:
    _LIBC = None


def trim() -> None:
    """Give freed memory back, as a worker that waits for its next task would keep it."""
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (splitmix64's finalizer)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=8)
def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(1234567 + seed).integers(0, 2**64, 256, dtype=U)


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64."""
    have = _POWERS.get((base, 0))
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 20), base, dtype=U)
        p[0] = 1
        have = _POWERS[base, 0] = np.multiply.accumulate(p)
    return have[:n]


#: Odd, so each has an inverse modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Words:
    """The words of ``texts``: ``hash``, byte ``start`` and ``end`` in ``raw``; text i has words ``first[i]`` to ``first[i+1]``."""

    def __init__(self, texts: list[str | None], lower: bool = False, seed: int = 0):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.raw = b"\n".join(parts) + b"\n" if parts else b""
        buf = np.frombuffer(self.raw, dtype=np.uint8)
        if lower:
            buf = _LOWER[buf]
        self.buf = buf
        space = _SPACE[buf]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts)))
        self.first = np.concatenate([np.zeros(1, np.int64), np.searchsorted(self.start, ends)])
        self.hash = self.hashes(seed)

    def hashes(self, seed: int = 0) -> np.ndarray:
        n, base = len(self.buf), BASES[seed % 2]
        prefix = np.zeros(n + 1, dtype=U)
        np.cumsum(_table(seed)[self.buf] * _powers(base, n), out=prefix[1:])
        back = _powers(_inverse(base), n + 1)
        return mix((prefix[self.end] - prefix[self.start]) * back[self.start] + (self.end - self.start).astype(U))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def windows(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``k`` values; entry i starts at value i."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    base = BASES[seed % 2]
    prefix = np.zeros(len(hashes) + 1, dtype=U)
    np.cumsum(hashes * _powers(base, len(hashes)), out=prefix[1:])
    return mix((prefix[k:] - prefix[:-k]) * _powers(_inverse(base), n) + U(seed + 1))


def within(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """Which of the ``total - k + 1`` window starts keep to one text."""
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    stop = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(k, k + n) <= stop


def slices(n_chars: list[int], most: int) -> list[tuple[int, int]]:
    """Runs of texts of about ``most`` characters."""
    out, start, used = [], 0, 0
    for i, n in enumerate(n_chars):
        if used and used + n > most:
            out.append((start, i))
            start, used = i, 0
        used += n
    if start < len(n_chars):
        out.append((start, len(n_chars)))
    return out
