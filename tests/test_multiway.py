"""Counting inside jobs: the closing kernel, boxes of shards and shares, overlaps by halving, and what plans move."""

from __future__ import annotations

import collections
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trigrid import graph, multiway, partition, triangles
from trigrid.storage import Workspace


def frame(spark, edges):
    return spark.createDataFrame(list(edges), "src long, dst long")


def random_edges(seed, n, m, hub=None):
    rng = random.Random(seed)
    edges = {tuple(sorted((rng.randrange(n), rng.randrange(n)), reverse=True)) for _ in range(m)}
    edges |= {tuple(sorted((hub, x), reverse=True)) for x in range(n)} if hub is not None else set()
    return sorted((a, b) for a, b in edges if a != b)


def brute(edges):
    have = set(edges)
    out = {v: set() for e in edges for v in e}
    for a, b in edges:
        out[a].add(b)
    return [(a, b, c) for a, b in edges for c in out[b] if (a, c) in have]


@pytest.mark.parametrize("seed", range(8))
def test_closing_several_jobs_at_once(seed, monkeypatch):
    monkeypatch.setattr(multiway, "PROBES", 37)
    rng = random.Random(seed)
    rows, want = [], collections.Counter()
    for job in range(4):
        parts = [{(rng.randrange(12), rng.randrange(12)): rng.randrange(3) * 10 for _ in range(rng.randrange(60))} for _ in range(3)]
        rows += [(job, role, a, b, edges[a, b]) for role, edges in enumerate(parts) for a, b in sorted(edges)]
        zero, one, two = parts
        want.update((zero[u, w], one[v, w], two[v, u]) for v, u in two for w in range(12) if (v, w) in one and (u, w) in zero)
    columns = [np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)]
    number = np.unique(columns[0], return_inverse=True)[1]
    assert multiway.close(number, *columns[1:]) == want


@pytest.mark.parametrize("job_edges", [1, 3, 4, 100])
@pytest.mark.parametrize("rows_a_batch", [1, 2, 5])
def test_jobs_that_span_batches(monkeypatch, job_edges, rows_a_batch):
    monkeypatch.setattr(multiway, "JOB_EDGES", job_edges)
    triangle = lambda j: [(j, 0, 2, 3, j), (j, 1, 1, 3, j), (j, 2, 1, 2, j)]
    rows = [r for j in (7, 9, 10, 14) for r in triangle(j)]
    columns = ("job", "role", "src", "dst", "label")
    batches = [pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows[k : k + rows_a_batch]]) for i, c in enumerate(columns)}) for k in range(0, len(rows), rows_a_batch)]
    got = [tuple(x.values()) for b in multiway._counted(batches) for x in b.to_pylist()]
    assert got == [(j, j, j, 1) for j in (7, 9, 10, 14)]


@pytest.mark.parametrize("job_edges", [5, 40, 10_000])
def test_boxes_hold_each_triangle_once(spark, job_edges):
    edges = random_edges(job_edges, 90, 500, hub=3)
    ws = Workspace(spark)
    e = ws.keep(frame(spark, edges).withColumn("label", F.expr("src % 3 * 10 + dst % 3")), "e")
    label = lambda a, b: a % 3 * 10 + b % 3
    want = collections.Counter((label(b, c), label(a, c), label(a, b)) for a, b, c in brute(edges))
    got = {(r.l0, r.l1, r.l2): r.triangles for r in multiway.by_boxes(e, ws, job_edges).collect()}
    assert got == want and sum(want.values()) > 100


@pytest.mark.parametrize(("limit", "width", "least"), [(10, 16, 0), (40, 64, 0), (40, 64, 3), (5, 7, 0), (10_000, 1 << 24, 0)])
def test_shards_fit_their_limit(spark, limit, width, least):
    edges = random_edges(limit, 90, 500, hub=3)
    levels = (width - 1).bit_length()
    shards = partition.split(frame(spark, edges), limit, levels, width, least)
    if least:
        assert shards.where(F.col("depth") < least).count() == 0
    assert shards.where((F.col("edges") > limit) & (F.col("depth") < levels)).count() == 0
    assert shards.agg(F.sum("edges")).first()[0] == len(edges)
    if width & (width - 1) == 0:
        counted = triangles.per_job(frame(spark, edges), shards, width)
        assert counted.agg(F.sum("triangles")).first()[0] == len(brute(edges))


@pytest.mark.parametrize("size", [7, 100, 10_000])
def test_slices(spark, size):
    edges = random_edges(size, 60, 400)
    counted = triangles.per_slice_triple(frame(spark, edges), size, 16)
    grids, place = {}, {}
    for a, b in edges:
        grids.setdefault((a // 16, b // 16), []).append((a, b))
    for (gr, gc), own in grids.items():
        place |= {e: (gr, gc, k // size) for k, e in enumerate(sorted(own))}
    want = collections.Counter((place[b, c], place[a, c], place[a, b]) for a, b, c in brute(edges))
    assert {(tuple(r.g0), tuple(r.g1), tuple(r.g2)): r.triangles for r in counted.collect()} == want


@pytest.mark.parametrize("k", [1, 2, 5])
def test_shares(spark, k):
    edges = random_edges(k, 60, 400, hub=0)
    o = triangles.pointed(frame(spark, edges))
    assert multiway.by_shares(o, k).agg(F.sum("triangles")).first()[0] == len(brute(edges))
    assert multiway.shares_for(10**9, 10**6) == math.ceil(math.sqrt(3000))


@pytest.mark.parametrize("strategy", ["bitmap", "edge_iterator", "grid", "sharded", "hash"])
def test_strategies_on_dense_and_wide_ids(spark, strategy):
    dense = list(itertools.combinations(range(4000, 4150), 2))
    shift = [(a * 5000 + 10**9, b * 5000 + 10**9) for a, b in itertools.combinations(range(12), 2)] + [(10**9, 70)]
    for edges, want in ((dense, math.comb(150, 3)), (shift, math.comb(12, 3))):
        options = {"width": 64, "depth": 2} if strategy in ("grid", "sharded") else {}
        assert triangles.count(frame(spark, edges), strategy, **options).first()[0] == want


def test_bit_arrays_hold_the_neighbours(spark):
    edges = [(5, d) for d in (0, 1, 63, 64, 4095, 4096, 9000)] + [(7, 12_345)]
    rows = {(r.src, r.block): r for r in triangles.bit_arrays(frame(spark, edges)).collect()}
    assert set(rows) == {(5, 0), (5, 1), (5, 2), (7, 3)}
    back = []
    for (src, block), r in rows.items():
        assert r.summary & ((1 << 64) - 1) == sum(1 << k for k in r.ks) and len(r.words) == len(r.ks)
        back += [(src, block * 4096 + k * 64 + i) for k, word in zip(r.ks, r.words, strict=True) for i in range(64) if word >> i & 1]
    assert sorted(back) == sorted(edges)


def test_overlaps_meet_by_equality_only(spark):
    rng = random.Random(3)
    rows = set()
    while len(rows) < 120:
        gr, gc, depth = rng.randrange(3), rng.randrange(3), rng.randrange(4)
        rows.add((gr, gc, depth, rng.randrange(1 << depth), rng.randrange(1 << depth)))
    shards = spark.createDataFrame(sorted(rows), "gr long, gc long, depth int, sr long, sc long")
    span = lambda g, d, s: (g * 8 + s * (8 >> d), g * 8 + (s + 1) * (8 >> d))
    meets = lambda p, q: max(p[0], q[0]) < min(p[1], q[1])
    row, col = {r: span(r[0], r[2], r[3]) for r in rows}, {r: span(r[1], r[2], r[4]) for r in rows}
    want = {(z, o, t) for o in rows for t in rows if meets(row[o], row[t]) for z in rows if meets(col[o], col[z]) and meets(row[z], col[t])}
    jobs = partition.shard_jobs(shards)
    got = [tuple(tuple(r[g]) for g in ("g0", "g1", "g2")) for r in jobs.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_plans_move_edges_not_wedges(spark):
    """The counting job's plan joins edges with boxes and shuffles by job; nothing joins edges with edges."""
    edges = random_edges(1, 50, 300)
    ws = Workspace(spark)
    e = ws.keep(graph.normalize(frame(spark, edges)), "e")
    boxes = spark.createDataFrame([(0, 0, 0, 0, 99, 0, 99)], "id long, job long, role int, s0 long, s1 long, d0 long, d1 long")
    dealt = e.withColumns({"id": F.lit(0).cast("long"), "label": F.lit(0).cast("long")}).join(boxes, "id").where("src >= s0 AND src < s1 AND dst >= d0 AND dst < d1")
    plan = multiway.count_jobs(dealt)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") <= 2 and "hashpartitioning(job" in plan


def test_quadtree_counts_edges_once(spark, monkeypatch):
    """Edges are read for one count a pass; only cells above the limit are gone into further."""
    edges = [(1000 + a, b) for a in range(40) for b in range(40)] + [(5000 * k + 1, k) for k in range(60)]
    seen = []
    keep = Workspace.keep
    monkeypatch.setattr(Workspace, "keep", lambda self, df, name, *a: (seen.append(name), keep(self, df, name, *a))[1])
    shards = partition.quadtree(frame(spark, edges), 100, 1 << 20)
    got = shards.collect()
    passes = [n for n in seen if n.startswith("cells-")]
    assert sum(r.edges for r in got) == len(edges) and all(r.edges <= 100 for r in got)
    assert len(passes) == len(set(passes)) <= 6
    assert partition.quadtree(frame(spark, []), 100).count() == 0
    for bad in (0, 7, 24):
        with pytest.raises(ValueError):
            partition.quadtree(frame(spark, edges), 5, bad or 3)
