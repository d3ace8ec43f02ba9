"""Job triples: rows stream from tasks that hold lists and one owner's results, whatever the matrix."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trigrid import closing, partition


def batch(rows):
    """Rows (job, role, src, dst) or with labels."""
    columns = {"job": pa.array([r[0] for r in rows], pa.int32()), "role": pa.array([r[1] for r in rows], pa.int32()), "src": pa.array([r[2] for r in rows], pa.int64())}
    columns["dst"] = pa.array([r[3] for r in rows], pa.list_(pa.int64()))
    if len(rows[0]) > 4:
        columns["label"] = pa.array([r[4] for r in rows], pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict(columns)


def cells_of(seed, n):
    rng = random.Random(seed)
    cells = sorted({tuple(sorted((rng.randrange(n), rng.randrange(n)), reverse=True)) for _ in range(n * n // 3)})
    lists = {}
    for a, b in cells:
        lists.setdefault(a, []).append(b)
    return cells, lists


def triples_of(cells, lists):
    return [(a, b, c) for a, b in cells for c in lists.get(b, ()) if c in set(lists[a])]


@pytest.mark.parametrize("probes", [1, 7, 1 << 20])
@pytest.mark.parametrize("long", [1, 64])
@pytest.mark.parametrize("marks", [1, 1 << 26])
def test_triples_with_ranges(probes, long, marks, monkeypatch):
    for k, v in (("PROBES", probes), ("LONG", long), ("MARKS", marks)):
        monkeypatch.setattr(closing, k, v)
    cells, lists = cells_of(4, 16)
    ranges = {x: random.Random(17 * x[0] + x[1]).choice([1, 1, 1, 2, 3]) for x in cells}
    own = [(a, b, [ranges[a, x] for x in b]) for a, b in lists.items()]
    rows = [(j, role, *x) for j in (0, 1) for role in (0, 2) for x in own]
    got = []
    for out in closing._triple_rows([batch(rows[x : x + 5]) for x in range(0, len(rows), 5)], ["k0", "k1", "k2"]):
        for a, b, cs, *ks in zip(*(out.column(i).to_pylist() for i in range(6)), strict=True):
            got += [(a, b, *x) for x in zip(cs, *([0] * len(cs) if k is None else k for k in ks), strict=True)]
    want = [(a, b, c, x, y, z) for a, b, c in triples_of(cells, lists) for x in range(ranges[b, c]) for y in range(ranges[a, c]) for z in range(ranges[a, b])]
    assert sorted(got) == sorted(want * 2) and len(want) > 200


@pytest.mark.parametrize("probes", [1, 7, 1 << 20])
def test_results_come_with_their_owner(probes, monkeypatch):
    """Results of one owner at a time: as many as the cube of the side may come, and a task never holds them all."""
    monkeypatch.setattr(closing, "PROBES", probes)
    held = []
    known = closing._counted_at
    monkeypatch.setattr(closing, "_counted_at", lambda b, bounds, c, results: (held.append(results.shape[1]), known(b, bounds, c, results))[1])
    cells, lists = cells_of(5, 12)
    every = triples_of(cells, lists)
    n = {t: k + 1 for k, t in enumerate(every) if k % 3}
    rows = [(0, 0, a, b) for a, b in lists.items()]
    for a, b in lists.items():
        rows += [(0, 1, a, [t[1], t[2], k]) for t, k in n.items() if t[0] == a] + [(0, 2, a, b)]
    got = {}
    for out in closing._triple_rows([batch(rows[x : x + 3]) for x in range(0, len(rows), 3)], ["n"]):
        for a, b, cs, ns in zip(*(out.column(i).to_pylist() for i in range(4)), strict=True):
            got |= {(a, b, c): k for c, k in zip(cs, ns or [0] * len(cs), strict=True)}
    assert got == {t: n.get(t, 0) for t in every}
    assert max(held) == max(sum(t[0] == a for t in n) for a in lists) < len(n) / 3


def test_jobs_grow_with_results(spark, monkeypatch):
    monkeypatch.setattr(closing, "RESULTS", 10)
    lists = spark.createDataFrame([(a, list(range(a + 1))) for a in range(12)], "src long, dst array<long>")
    results = spark.createDataFrame([(a, b, 0, 5) for a in range(12) for b in range(a)] * 4, "a long, b long, c long, n long")
    p, q = closing.shape(78, spark.sparkContext.defaultParallelism)
    assert closing.deal_cells(lists, 78, results).rdd.getNumPartitions() >= 264 / 10 > p * q


def test_a_task_keeps_no_table_of_a_large_matrix():
    """A full table of 4 bytes a cell would be several times the lists."""
    rng = np.random.default_rng(3)
    lists = [np.flatnonzero(rng.random(6000) < 0.7) for _ in range(4000)]
    parts = [(np.arange(len(lists)), np.array([len(x) for x in lists]), np.concatenate(lists).astype(np.int32), None)]
    assert closing._Held(parts, "sorted").probe == "sorted"


def test_sizes_tell_slices(spark, monkeypatch):
    monkeypatch.setattr(partition, "with_slice", lambda *a: pytest.fail("edges sorted"))
    rng = random.Random(8)
    edges = {(a, rng.randrange(a)) for a in range(1, 60) for _ in range(12)}
    sizes = {}
    for a, b in edges:
        sizes[a // 16, b // 16] = sizes.get((a // 16, b // 16), 0) + 1
    want = {(*g, k): min(7, n - 7 * k) for g, n in sizes.items() for k in range(-(-n // 7))}
    e = spark.createDataFrame(sorted(edges), "src long, dst long")
    slices = partition.linear_slices(e, 7, 16)
    assert {(r.gr, r.gc, r.slice): r.edges for r in slices.collect()} == want
    jobs = partition.slice_jobs(slices)
    number = {g: -(-n // 7) for g, n in sizes.items()}
    of = lambda *g: number.get(g, 0)
    total = sum(of(i, c) * of(r, c) * of(r, i) for r in range(4) for i in range(r + 1) for c in range(i + 1))
    assert jobs.count() == jobs.distinct().count() == total
    assert jobs.select(F.col("g0.slice").alias("k"), "g0.gr", "g0.gc").distinct().count() <= len(want)
