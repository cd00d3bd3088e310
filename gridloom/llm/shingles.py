"""Word shingles of many texts at once, as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .common import spans_of

STEP_BYTES = 1 << 20
_RNG = np.random.default_rng(97)
_VALUES = _RNG.integers(0, 2**64, 256, np.uint64, endpoint=False)  # a number per byte
_VALUES[65:91] = _VALUES[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 2**64)
_ODD = _RNG.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    h = h + np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Shingler:
    """Distinct shingles of ``words`` words; a shorter text's whole word sequence is one shingle."""

    def __init__(self, words: int):
        self.words = words
        self.up = self.down = np.ones(1, np.uint64)

    def _word_hashes(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of every word; words do not run over from text to text."""
        inner = ~_SPACE[codes]
        edge = np.zeros(len(codes) + 1, bool)
        edge[at] = True
        begins = np.flatnonzero(inner & np.concatenate([[True], ~inner[:-1]]) | inner & edge[:-1])
        ends = np.flatnonzero(inner & np.concatenate([~inner[1:], [True]]) | inner & edge[1:]) + 1
        if len(self.up) < len(codes):
            self.up, self.down = _powers(_BASE, len(codes)), _powers(_INVERSE, len(codes))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUES[codes] * self.up[:len(codes)], dtype=np.uint64)])
        hashes = mixed((sums[ends] - sums[begins]) * self.down[begins])
        return hashes, np.searchsorted(at, begins, side="right") - 1

    def _step(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        count = len(at) - 1
        at = at - at[0]
        if not len(data):
            return [np.zeros(0, np.uint64)] * count
        hashes, text = self._word_hashes(data, at)
        per_text = np.bincount(text, minlength=count)
        first = np.cumsum(per_text) - per_text
        k = self.words
        total = max(0, len(hashes) - k + 1)
        rows = np.zeros(total, np.uint64)
        for j in range(k):
            rows += hashes[j:j + total] * _ODD[j]
        rows = mixed(rows)
        out = []
        for i in range(count):
            n, f = int(per_text[i]), int(first[i])
            if n >= k:
                out.append(np.unique(rows[f:f + n - k + 1]))
            elif n:
                out.append(mixed((hashes[f:f + n] * _ODD[:n]).sum(keepdims=True, dtype=np.uint64), n))
            else:
                out.append(np.zeros(0, np.uint64))
        return out

    def sets(self, data: np.ndarray, at: np.ndarray):
        """The sorted set of every text ``data[at[i]:at[i + 1]]``, in order."""
        for first, last in spans_of(at, STEP_BYTES):
            yield from self._step(data[at[first]:at[last]], at[first:last + 1])
