"""Periodic runs of words: found by masking repeated k-grams, then by divide and conquer on what survives.

A run is a maximal stretch with smallest period q and a length of at least ``max(MIN_LENGTH, MIN_EXPONENT * q)`` words. Shifted by
its period a run overlaps itself by its length less q words, at least ``OVERLAP`` of them, so each of its words lies in
an ``OVERLAP``-gram that occurs twice in the document. Words outside such grams can be in no run; the maximal stretches of the
others are the segments that survive, and every run lies within one. The mask goes by hashes and can only keep too much.

On the segments runs are found as Main and Lorentz do: halve; a run that crosses the middle of its half holds, for its
period p, either the two words (m, m + p) or (m - 1 - p, m - 1); how far both sides agree forwards and backwards gives the
whole stretch. All halves of one level, of all segments of a slice of documents, are worked on together in numpy. Extents come
from prefix hashes by binary search over words numbered exactly; each stretch is then compared word by word, and extended
anew word by word should hashes have lied, so results are exact.

Defined results: a null or empty text has no words and no runs (four nulls, digests of the empty string); a null doc_id
leaves the text as it is; of stretches with equal exponents the first start, then the smallest period, is the strongest; rows that are
repeated or share a doc_id keep a row each; texts of any length are worked on whole; an empty table gives an empty
result; columns besides id and text, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, keyed_texts
from .textkernel import Words, gram_codes, mix64, prefix_codes

MIN_LENGTH = 24
MIN_EXPONENT = 3


def least_overlap(min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> int:
    """The fewest words by which a run overlaps itself when shifted by its period."""
    return min(max(min_length, min_exponent * q) - q for q in range(1, min_length + 1))


OVERLAP = least_overlap()


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """Which original word stands at each place of a document of ``n`` words: a tenth of the documents, by the crc32 of the id,
    repeat a stretch of theirs to the end."""
    at = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


def surviving(hashes: np.ndarray, first: np.ndarray, k: int = OVERLAP, least: int = MIN_LENGTH) -> list[tuple[int, int]]:
    """Maximal stretches of words, ``least`` long or more, that lie in k-grams found twice in their document; documents are
    ``hashes[first[i]:first[i + 1]]``."""
    n = len(hashes)
    if n < k:
        return []
    start = np.arange(n - k + 1)
    doc = np.searchsorted(first, start, side="right") - 1
    inside = start + k <= first[doc + 1]
    start, doc = start[inside], doc[inside]
    key = gram_codes(hashes, k)[inside] + mix64(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(start), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    depth = np.zeros(n + 1, dtype=np.int32)
    depth[start[twice]] += 1
    depth[start[twice] + k] -= 1
    covered = np.concatenate(([False], np.cumsum(depth)[:n] > 0, [False]))
    # Neighbouring documents may both be covered up to their common border.
    border = np.zeros(n + 1, dtype=bool)
    border[first] = True
    lo = np.flatnonzero(covered[1:-1] & (~covered[:-2] | border[:-1]))
    hi = np.flatnonzero(covered[1:-1] & (~covered[2:] | border[1:])) + 1
    return [(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b - a >= least]


class _Extents:
    """How far equal words go on from two places of one segment, by prefix hashes."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.total, self.up = prefix_codes(mix64(words.astype(np.uint64) + np.uint64(1)))

    def equal(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from x on equal those from y on (x < y)."""
        left = (self.total[x + n] - self.total[x]) * self.up[y - x]
        return left == self.total[y + n] - self.total[y]

    def _longest(self, most: np.ndarray, holds) -> np.ndarray:
        lo, hi = np.zeros_like(most), most.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi + 1) // 2
            ok = holds(mid)
            lo = np.where(open_ & ok, mid, lo)
            hi = np.where(open_ & ~ok, mid - 1, hi)
        return lo

    def forward(self, x: np.ndarray, y: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._longest(end - y, lambda n: self.equal(x, y, n))

    def backward(self, x: np.ndarray, y: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Words before x and before y."""
        return self._longest(x - begin, lambda n: self.equal(x - n, y - n, n))


def _stretch(words: np.ndarray, x: int, p: int, begin: int, end: int) -> tuple[int, int]:
    """The maximal stretch of period p around the equal words x and x + p, word by word."""
    ahead = np.flatnonzero(words[x : end - p] != words[x + p : end])
    behind = np.flatnonzero(words[begin:x][::-1] != words[begin + p : x + p][::-1])
    return x - (int(behind[0]) if len(behind) else x - begin), x + p + (int(ahead[0]) if len(ahead) else end - p - x)


def find_runs(words: np.ndarray, segments: list[tuple[int, int]], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """(start, end, period) of every run within the segments of ``words`` (numbers, equal ones for equal words), sorted."""
    if not segments:
        return np.zeros((0, 3), dtype=np.int64)
    extents = _Extents(words)
    lo, hi = (np.array(x, dtype=np.int64) for x in zip(*segments, strict=True))
    begin, end = lo, hi
    found = []
    while len(lo):
        mid, most = (lo + hi) // 2, (hi - lo) // min_exponent
        node = np.repeat(np.arange(len(lo)), most)
        p = np.arange(len(node)) - np.repeat(np.cumsum(most) - most, most) + 1
        for x in (mid[node], mid[node] - 1 - p):
            y = x + p
            ok = (x >= lo[node]) & (y < hi[node])
            ok[ok] = words[x[ok]] == words[y[ok]]
            xs, ps, b, e = x[ok], p[ok], begin[node[ok]], end[node[ok]]
            start = xs - extents.backward(xs, xs + ps, b)
            stop = xs + ps + extents.forward(xs, xs + ps, e)
            long = stop - start >= np.maximum(min_length, min_exponent * ps)
            found.append(np.stack([start[long], stop[long], ps[long], xs[long], b[long], e[long]], axis=1))
        # A run that touches no middle lies within a half.
        keep = np.concatenate([mid - lo >= min_length, hi - mid >= min_length])
        lo, hi, begin, end = (np.concatenate(pair)[keep] for pair in ((lo, mid), (mid, hi), (begin, begin), (end, end)))
    return _exact(words, np.concatenate(found), min_length, min_exponent)


def _exact(words: np.ndarray, found: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Stretches confirmed word by word, each with its smallest period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    same = np.zeros(len(found), dtype=bool)
    same[1:] = (found[1:, :3] == found[:-1, :3]).all(axis=1)
    sure, doubted = [], set()
    for s, e, p, *_ in found[~same].tolist():
        if not np.array_equal(words[s : e - p], words[s + p : e]):
            doubted.add((s, e, p))
        else:
            sure.append((s, e, p))
    if doubted:
        for s, e, p, x, b, t in found.tolist():
            if (s, e, p) in doubted:
                s, e = _stretch(words, x, p, b, t)
                if e - s >= max(min_length, min_exponent * p):
                    sure.append((s, e, p))
    smallest: dict[tuple[int, int], int] = {}
    for s, e, p in sure:
        smallest[s, e] = min(p, smallest.get((s, e), p))
    return np.array(sorted((s, e, p) for (s, e), p in smallest.items()), dtype=np.int64).reshape(-1, 3)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The (start, end, period) of the greatest length over period; ties by start, then period."""
    best = None
    for s, e, p in runs:
        if best is None or (e - s) * best[2] > (best[1] - best[0]) * p:
            best = (s, e, p)
    return best


def _scan(batch: pa.RecordBatch, texts: bool) -> dict:
    ids = batch.column("doc_id").to_pylist()
    w = Words(batch.column("text").to_pylist())
    at = np.concatenate([w.first[i] + planted(d, w.first[i + 1] - w.first[i]) for i, d in enumerate(ids)]) if ids else np.zeros(0, dtype=np.int64)
    segments = surviving(w.hashes()[at], w.first)
    spelled, numbers = {}, np.full(len(at), -1, dtype=np.int64)
    starts, ends = w.starts.tolist(), w.ends.tolist()
    for a, b in segments:
        numbers[a:b] = [spelled.setdefault(w.blob[starts[k] : ends[k]], len(spelled)) for k in at[a:b].tolist()]
    runs = find_runs(numbers, segments)
    bounds = np.searchsorted(runs[:, 0], w.first)
    out: dict[str, list] = {k: [] for k in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed_text")}
    for i in range(len(ids)):
        base, n = int(w.first[i]), int(w.first[i + 1])
        own = [(s - base, e - base, p) for s, e, p in runs[bounds[i] : bounds[i + 1]].tolist()]
        places = at[base:n]
        if own:
            keep = np.ones(n - base, dtype=bool)
            for s, e, p in own:
                keep[s + p : e] = False
            places = places[keep]
        s, e, p = strongest(own) or (None, None, None)
        listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in own)
        kept = b" ".join([w.blob[starts[k] : ends[k]] for k in places.tolist()])
        row = (len(own), s, e and e - s, p, e and 1000 * (e - s) // p, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
        for name, value in zip(out, (*row, kept.decode("utf-8", "surrogatepass") if texts else None), strict=True):
            out[name].append(value)
    whole = {name: pa.array(out[name], pa.int64()) for name in ("n_runs", "start", "length", "period", "exponent_milli")}
    digests = {name: pa.array(out[name], pa.string()) for name in ("runs_sha256", "collapsed_sha256", *["collapsed_text"] * texts)}
    return {"doc_id": batch.column("doc_id"), **whole, **digests}


def collapse_runs(docs: DataFrame, texts: bool = False) -> DataFrame:
    """One row per document: its runs' number and digest, the strongest one, and the digest of the text with each run cut to its
    first period (``texts`` adds that text)."""
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return arrow_map(keyed_texts(docs), lambda b: _scan(b, texts), schema + ", collapsed_text string" * texts)
