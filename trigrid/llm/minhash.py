"""One-permutation minhash with optimal densification (numpy kernel of the near-duplicate job)."""

from __future__ import annotations

import numpy as np

from .textkernel import Words, mix64

SHINGLE = 5
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
_SHIFT = np.uint64(64 - (BINS.bit_length() - 1))
#: Row j: the order in which an empty bin j looks for a filled one; the same for every document,
#: so equal sets densify alike, and each empty bin draws its own uniform choice.
_PROBES = np.argsort(mix64(np.arange(1, BINS * BINS + 1, dtype=np.uint64)).reshape(BINS, BINS), axis=1)
_COEF = mix64(np.arange(11, 11 + BINS, dtype=np.uint64)) | np.uint64(1)
_BAND = mix64(np.arange(101, 101 + BINS, dtype=np.uint64))
#: Largest chance that a pair at the threshold shares no bucket.
MOST_MISSED = 1e-7


def rows_for(similarity: float) -> int:
    """The most bins a band may have for pairs of that similarity to share a bucket."""
    return max((r for r in range(1, BINS + 1) if (1 - similarity**r) ** (BINS // r) <= MOST_MISSED), default=1)


def shingle_sets(words: Words) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its 5-word shingles; fewer words are one shingle."""
    counts, first = words.counts(), words.first
    grams = words.grams(SHINGLE)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    whole = dict(zip(short.tolist(), words.spans(first[short], first[short + 1]), strict=True)) if len(short) else {}
    out = []
    for i, n in enumerate(counts.tolist()):
        if n >= SHINGLE:
            out.append(np.unique(grams[first[i] : first[i] + n - SHINGLE + 1]))
        else:
            out.append(np.array([whole[i]] if n else [], dtype=np.uint64))
    return out


def signature(members: np.ndarray) -> np.ndarray:
    """The minimum of each of the 128 bins (by the hash's top bits) of a sorted non-empty set."""
    at = (members >> _SHIFT).astype(np.int64)
    lead = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    sig = np.zeros(BINS, dtype=np.uint64)
    full = np.zeros(BINS, dtype=bool)
    full[at[lead]] = True
    sig[at[lead]] = members[lead]
    empty = np.flatnonzero(~full)
    if len(empty):
        probes = _PROBES[empty]
        sig[empty] = sig[probes[np.arange(len(empty)), full[probes].argmax(axis=1)]]
    return sig


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket key for each band of ``rows`` bins."""
    n = BINS // rows
    return mix64((mix64(sig[: n * rows]).reshape(n, rows) * _COEF[:rows]).sum(axis=1, dtype=np.uint64) ^ _BAND[:n])
