"""Periodic runs against a search of every period, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from trigrid.llm import periodic, queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_runs int, start string"


def brute_runs(words):
    """Every maximal stretch of every period, straight from the definition."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        s = 0
        while s + q < len(words):
            e = s + q
            while e < len(words) and words[e] == words[e - q]:
                e += 1
            if e - s >= max(24, 3 * q) and (s, e) not in found:
                found[s, e] = q
            s = max(s + 1, e - q + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def expected(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(kept))


def results(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_least_overlap_follows_from_length_and_exponent():
    assert periodic.OVERLAP == 16
    assert periodic.least_overlap(30, 2) == min(max(30, 2 * q) - q for q in range(1, 200)) == 15


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_random_and_periodic_words(seed):
    rng = random.Random(seed)
    words = []
    while len(words) < 400:
        q = rng.randint(1, 40)
        unit = [rng.randint(0, rng.choice([1, 2, 5, 300])) for _ in range(q)]
        words += (unit * rng.randint(1, 9))[: rng.randint(1, 200)]
    array = np.array(words)
    got = periodic.find_runs(array, [(0, len(words))])
    assert [(s, e - s, q) for s, e, q in got.tolist()] == brute_runs(words)
    masked = periodic.surviving(array.astype(np.uint64), np.array([0, len(words)]))
    assert np.array_equal(periodic.find_runs(array, masked), got)


def test_stretches_that_hashes_make_too_long_are_mended(monkeypatch):
    monkeypatch.setattr(periodic._Extents, "equal", lambda self, x, y, n: np.ones(len(x), dtype=bool))
    words = np.array([9, 8] + [1, 2, 3] * 12 + [7, 6, 7, 5])
    assert periodic.find_runs(words, [(0, len(words))]).tolist() == [[2, 38, 3]]


def test_mask_keeps_documents_apart():
    words = np.array([1, 2, 3, 4] * 20 + [5] * 30 + list(range(100, 150)), dtype=np.uint64)
    assert periodic.surviving(words, np.array([0, 80, 110, 160])) == [(0, 80), (80, 110)]
    assert periodic.surviving(words[:10], np.array([0, 10])) == []


def test_query_against_every_period(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    docs = {r.doc_id: r.text for r in docs}
    got = results(queries.op11_periodic_runs(spark, SMALL))
    assert [r for r in got if len(docs[r[0]]) < 6000] == sorted((expected(i, t) for i, t in docs.items() if len(t) < 6000), key=repr)
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got) > 5


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(60_000)) + " a b c" * 20_000
    rows = [(None, "a b " * 30), (1, None), (2, ""), (3, " \n\t "), (4, "x " * 24), (5, "x " * 23), (6, "é ü\n" * 40 + "end"), (6, "é ü\n" * 40 + "end"), (7, " y".join("z" * 50))]
    df = spark.createDataFrame([(i, t, -1, "clash") for i, t in rows], SCHEMA)
    assert results(periodic.collapse_runs(df)) == sorted((expected(i, t) for i, t in rows), key=repr)
    (row,) = periodic.collapse_runs(spark.createDataFrame([(8, long)], "doc_id long, text string"), texts=True).collect()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 60_000, 60_000, 3) and row.collapsed_text.endswith("59999 a b c")
    assert periodic.collapse_runs(df.limit(0)).count() == 0
