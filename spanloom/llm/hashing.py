"""Vectorised hashes of all substrings of one length, over many texts at once.

A polynomial hash modulo 2**64 with an odd base lets any substring's hash be read off one prefix sum: code points are
first spread over 64 bits, and results are mixed, so that the weak low bits of such hashes do no harm.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that makes every bit depend on every other."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts after each other, offsets of the texts with the total length last)."""
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), offsets


class Rolling:
    """Substring hashes of a sequence of code points."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        up, self.down = _powers(n + 1)
        x = points.astype(np.uint64)
        x += np.uint64(1)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= up[:n]
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(x, out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Hash of each substring of ``length``, by its start; empty where the sequence is shorter."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each [start, end)."""
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + ends.astype(np.uint64) - starts.astype(np.uint64))
