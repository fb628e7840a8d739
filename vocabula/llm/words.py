"""Words of whole batches of texts as numpy arrays: starts, ends and 64-bit hashes, without a Python object per word.

Words are the longest runs of letters and digits, lower-cased; everything else only separates them.
"""

from __future__ import annotations

import functools
import sys

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


@functools.cache
def word_characters() -> np.ndarray:
    """By code point: letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), np.bool_, sys.maxunicode + 1)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE), np.full(size, _INV)
        up[0] = down[0] = 1
        _powers[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """points: code points of all texts, lower-cased, each followed by a line break; starts, ends, hashes: by word;
    text: the index of each word's text; first: by text, its first word's index, and the total at the end."""

    def __init__(self, texts: list[str]):
        lowered = [(t or "").lower() for t in texts]
        blob = "\n".join(lowered) + "\n"
        self.points = np.frombuffer(blob.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = word_characters()[self.points]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
        self.starts, self.ends = edge[0::2], edge[1::2]  # the blob ends outside a word
        up, down = _power_tables(len(self.points))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.points.astype(np.uint64) + np.uint64(1)) * up[: len(self.points)], dtype=np.uint64)))
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))
        lengths = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.starts, self.offsets)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def words(self, start: int, end: int) -> list[str]:
        """The words from index start to end."""
        return ["".join(map(chr, self.points[a:b])) for a, b in zip(self.starts[start:end], self.ends[start:end])]


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; one for each start (fewer than k words: none)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _BASE + hashes[i : i + n]
    return mix(out)


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k values in a row."""
    width = 1
    while width * 2 <= k:
        x = np.minimum(x[:-width], x[width:]) if len(x) > width else x[:0]
        width *= 2
    rest = k - width
    return (np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0]) if rest else x
