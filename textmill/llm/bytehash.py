"""64-bit hashes of words, shingles and windows of whole texts, over many texts at a time in numpy.

A window's hash is a polynomial over random values of its bytes, taken from prefix sums modulo 2^64 and mixed. Two
different strings share a hash with a chance of about 2^-64 each.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values(folded: bool) -> np.ndarray:
    values = np.arange(256, dtype=np.uint64)
    if folded:  # A-Z as a-z
        values[65:91] += np.uint64(32)
    return mix((values + np.uint64(1)) * np.uint64(_BASE))


VALUES, FOLDED = _byte_values(False), _byte_values(True)
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept for later calls."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


class Joined:
    """Texts joined by single line feeds, with the prefix sums of their hashes."""

    def __init__(self, texts: list[bytes], folded: bool) -> None:
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1]
        base, self.inverse = powers(len(self.data))
        self.sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((FOLDED if folded else VALUES)[self.data] * base, out=self.sums[1:])

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the bytes from each first up to, not including, each last."""
        return mix((self.sums[last] - self.sums[first]) * self.inverse[first])

    def windows(self, size: int) -> np.ndarray:
        """Hash of the window that starts at each byte; those that cross a text's end mean nothing."""
        n = max(0, len(self.data) - size + 1)
        return mix((self.sums[size : size + n] - self.sums[:n]) * self.inverse[:n])

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts in a row, and the number of words of each text."""
        blank = BLANK[self.data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edge = np.concatenate([[0], edge])
        first, last = edge[0::2], edge[1::2]  # the data ends with a blank
        counts = np.diff(np.searchsorted(first, np.concatenate([self.starts, [len(self.data)]])))
        return self.hashes(first, last[: len(first)]), counts


def shingles(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words inside each text, with the text of each; a text with fewer words gives its whole sequence."""
    n = len(words)
    ends = np.cumsum(counts)
    short = np.flatnonzero((counts > 0) & (counts < size))
    text = np.repeat(np.arange(len(counts)), counts)
    total = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        total = total * _STEP + words[k : k + len(total)]
    inside = np.flatnonzero(np.arange(len(total)) + size <= ends[text[: len(total)]]) if n else np.zeros(0, np.int64)
    hashes, owners = mix(total[inside]), text[inside]
    if len(short):
        whole = []
        for t in short.tolist():
            h = np.zeros(1, np.uint64)
            for w in words[ends[t] - counts[t] : ends[t]]:
                h = h * _STEP + w
            whole.append(mix(h + np.uint64(counts[t]))[0])
        hashes, owners = np.concatenate([hashes, np.array(whole, np.uint64)]), np.concatenate([owners, short])
    return hashes, owners


def sets(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, sorted by text and then by hash."""
    order = np.argsort(hashes)
    order = order[np.argsort(owners[order], kind="stable")]
    hashes, owners = hashes[order], owners[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[keep], owners[keep]
