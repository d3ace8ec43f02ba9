"""Vectorised word and n-gram hashing shared by the text operators.

Everything here works on one bounded slice of an Arrow batch inside a Spark task: the texts of
the slice are laid end to end in one byte buffer, and numpy computes word borders, 64-bit word
hashes and n-gram hashes for all of them at once. Words are maximal runs of bytes other than
0x20 and 0x09-0x0D, which for UTF-8 are the matches of ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bytes of text handled at a time; bounds the working memory of a task.
SLICE_BYTES = 1_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BASES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD1342543DE82EF95 | 1))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, twice)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _byte_codes(which: int) -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D + 2 * which))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inv = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SLICE_BYTES + 4096)
            for name, b in (("up", self.base), ("down", self.inv)):
                steps = np.full(n, b & ((1 << 64) - 1), dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = [_Powers(b) for b in _BASES]


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Polynomial hash of values[starts[i]:ends[i]] for every i, the same wherever the range lies."""
    up, down = _POWERS[which].upto(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def byte_codes(which: int) -> np.ndarray:
    """The code of each byte value in one of two families of hashes."""
    return _byte_codes(which)


def prefix_sums(values: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the values times rising powers of a base, and the powers of its inverse: a range's difference of sums times
    the power at its start is its hash, wherever it lies."""
    up, down = _POWERS[which].upto(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return total, down


def gram_codes(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each place on (the last n - 1 places have none)."""
    at = np.arange(max(0, len(values) - n + 1))
    return mix64(_ranges(values, at, at + n, 0) + np.uint64(n))


def prefix_codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the values times rising powers, and the powers: of two equal ranges, the earlier one's difference
    times the power of their distance is the later one's."""
    up, _ = _POWERS[0].upto(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return total, up


class Words:
    """The words of a list of texts: ``starts``/``ends`` are byte borders in ``buffer``, and
    words of text i are ``first[i]:first[i + 1]``."""

    def __init__(self, texts: list[str | None], lower: bool = False) -> None:
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        blob = b"\n".join(raw) + b"\n"
        if lower:
            blob = blob.translate(_LOWER)
        self.blob = blob
        self.buffer = np.frombuffer(blob, dtype=np.uint8)
        inside = ~_SPACE[self.buffer]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.starts, self.offsets)
        self._hashes: dict[int, np.ndarray] = {}

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of every word; ``which`` picks one of two independent families."""
        if which not in self._hashes:
            h = _ranges(_byte_codes(which)[self.buffer], self.starts, self.ends, which)
            self._hashes[which] = mix64(h + (self.ends - self.starts).astype(np.uint64))
        return self._hashes[which]

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words with one space after each, and where every word starts there (the end last)."""
        sizes = self.ends - self.starts
        keep = ~_SPACE[self.buffer]
        keep[self.ends] = True
        plain = np.where(_SPACE[self.buffer], np.uint8(32), self.buffer)[keep]
        return plain.tobytes(), np.concatenate(([0], np.cumsum(sizes + 1)))

    def grams(self, n: int, which: int = 0) -> np.ndarray:
        """Hash of the n words from each word on (the last n - 1 of the slice have none); those
        that cross a text's end are for the caller to leave out."""
        w = self.hashes(which)
        at = np.arange(max(0, len(w) - n + 1))
        return mix64(_ranges(w, at, at + n, which) + np.uint64(n))

    def spans(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        """Hash of words starts[i]:ends[i] (positions in the slice)."""
        return mix64(_ranges(self.hashes(which), starts, ends, which) + (ends - starts).astype(np.uint64))


def slices(lengths: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose texts sum to about ``limit`` bytes; a longer text is alone."""
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)
