"""Vectorised hashing of words, shingles and substrings over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import flat

_U = np.uint64
with np.errstate(over="ignore"):
    _STEP = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (two multiplications, three shifts)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(29)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(32)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed * 1_000_003)) * _STEP)


class Rolling:
    """Hash of any substring from prefix sums of value[byte] * R^i modulo 2^64, and of R's inverse powers.

    R^i is the product of two table entries, of i's low and high half, so that the tables stay small whatever a text's length.
    """

    LOW = 16

    def __init__(self, seed: int = 1):
        self.values = seeds(256, seed)
        base = int(seeds(1, seed + 77)[0]) | 1
        self.bases = (base, pow(base, -1, 1 << 64))
        self.low = tuple(self._series(b, 1 << self.LOW) for b in self.bases)
        self.high = tuple(np.ones(1, _U) for _ in self.bases)

    @staticmethod
    def _series(base: int, n: int) -> np.ndarray:
        """base^0 .. base^(n-1), at least."""
        out = np.ones(1, _U)
        while len(out) < n:
            out = np.concatenate([out, out * _U(pow(base, len(out), 1 << 64))])
        return out

    def _factors(self, which: int, n: int, at: np.ndarray | None = None) -> np.ndarray:
        """R^i, or R^-i, for i in ``at`` (below n), or for all i below n."""
        rows = (n >> self.LOW) + 1
        if rows > len(self.high[which]):
            self.high = tuple(self._series(pow(b, 1 << self.LOW, 1 << 64), rows) for b in self.bases)
        low, high = self.low[which], self.high[which]
        if at is None:
            return (high[:rows, None] * low[None, :]).ravel()[:n] if rows > 1 else low[:n]
        at = np.asarray(at, np.int64)
        out = low[at & ((1 << self.LOW) - 1)]
        if rows > 1:
            out *= high[at >> self.LOW]
        return out

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, _U)
        np.cumsum(self.values[data] * self._factors(0, len(data)), out=out[1:])
        return out

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mixed hashes of the substrings [start, end)."""
        return mix((sums[ends] - sums[starts]) * self._factors(1, len(sums), starts))

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Mixed hashes of all windows of ``width`` bytes (they may cross texts; the caller masks those)."""
        n = len(sums) - width
        return mix((sums[width:] - sums[:n]) * self._factors(1, n)) if n > 0 else np.zeros(0, _U)


#: Bytes that belong to words: ASCII letters and digits, and every byte of a non-ASCII character.
WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_words = Rolling(11)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the lower-cased texts: (hashes, first word of each text and the end, bytes, starts, ends)."""
    data, offsets = flat(pc.utf8_lower(texts.cast(pa.large_string())))
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64), data, none, none
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = WORD_BYTE[data]
    edge = np.zeros(len(data) + 1, bool)  # a text starts here
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    hashes = _words.of(_words.sums(data), starts, ends)
    return hashes, np.searchsorted(starts, offsets), data, starts, ends


_FACTORS = seeds(64, 5) | _U(1)


def shingles(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text, text by text, and where each text's begin.

    A text of fewer than n words, but at least one, has one shingle: all its words.
    """
    counts = np.diff(bounds)
    per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(per)])
    first = np.repeat(bounds[:-1] - out_bounds[:-1], per) + np.arange(out_bounds[-1])
    last = np.repeat(bounds[1:], per)
    value = np.zeros(len(first), _U)
    padded = np.concatenate([hashes, np.zeros(n, _U)])
    for k in range(n):
        at = first + k
        value += np.where(at < last, padded[at], _U(k + 1)) * _FACTORS[k]
    return mix(value), out_bounds


def sequence_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit keys of each text's word sequence, as an (n, 2) array."""
    n = len(bounds) - 1
    at = (np.arange(len(hashes)) - np.repeat(bounds[:-1], np.diff(bounds))).astype(_U)
    out = np.zeros((n, 2), _U)
    for k in range(2):
        each = mix(hashes ^ mix(at * _STEP + _U(k + 1)))
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(each, dtype=_U)])
        out[:, k] = mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(_U))
    return out
